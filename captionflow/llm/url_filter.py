"""URL filters with redirect equivalence.

URLs that redirect to each other or name the same canonical page are one alias
class: classes are the connected components over redirect and canonical-link edges.
A rule's decision about one URL of a class reaches the URLs of the class that no
rule fits; a URL that only occurs as an end of an edge (a redirect's target that was
never crawled) is judged and decides like that of a page. A URL's own rule always
decides for it; within a class an explicit allow takes precedence over a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components
from .native import let


@dataclass(frozen=True)
class Rule:
    verdict: str   # allow or block
    host: str      # fits this host and its subdomains
    path: str      # fits paths that start with it

    @property
    def name(self) -> str:
        return self.host + self.path


# Query parameters that say where a visit came from, not which page.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid")


def _after(url: str, mark: str) -> Column:
    at = F.instr(F.col(url), mark)
    return F.when(at > 0, F.substring(F.col(url), at + len(mark), F.length(F.col(url)))).otherwise("")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``: what follows the first ``://`` up to /, ?
    or #, letters lowered, and from there up to ? or #; both empty without ``://``."""
    rest = _after(url, "://")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_column(rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path, or null; of
    rules of one length that fit the one whose name is later in code-point order, and of
    rules of one name the later in the list."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones win
        on_host = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        fits = on_host & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """The node of a URL: no scheme, host lowered, no fragment, no tracking
    parameters, no final slash. A URL without ``://`` has no host: it is a node of its
    own, whatever host it looks like. Null and empty stay without a node (null)."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    named = "(?:" + "|".join(TRACKING) + ")=[^&]*"
    bare = F.regexp_replace(bare, rf"(?<=[?&]){named}(?:&|$)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?&]+$", ""), r"/+$", "")
    host = F.regexp_extract(bare, r"^([^/?]*)", 1)
    whole = F.concat(ascii_lower(host), F.substring(bare, F.length(host) + 1, F.length(bare)))
    return F.nullif(F.when(F.contains(url, F.lit("://")), whole).when(url != "", F.concat(F.lit("\n"), url)), F.lit(""))


def _tag(name: str) -> str:
    """Pattern of a tag; a ``>`` inside quotes does not end it, if the quotes end."""
    return rf'(?i)<{name}\b(?:(?:[^>"\']++|"[^"]*+"|\'[^\']*+\')*+>|[^>]*+>)'


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or bare; empty without one."""
    pattern = (rf'(?i)^(?:\s|(?!{name}\s*=)[^"\'\s]++|"[^"]*+"|\'[^\']*+\')*+{name}\s*=\s*'
               r'(?:"([^"]*)"|\'([^\']*)\'|["\']?([^\s"\'>]+))')
    return F.trim(decoded(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])))


#: The target in a refresh's content; it may have quotes of its own.
_TARGET = r'(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(?:"([^"]*)|\'([^\']*)|([^"\'\s][^\s]*))'
# Named entities that occur in URLs.
_ENTITIES = (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"))


def decoded(c: Column) -> Column:
    """Text of an attribute with its entities, by name or number, decoded once."""
    def one(x: Column) -> Column:
        body = F.regexp_extract(x, r"^&([^;]*);", 1)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10)).otherwise(F.substring(body, 2, 8))
        # code points as UTF-32 bytes
        sign = F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")
        out = F.when(body.startswith("#"), sign)
        for name, value in _ENTITIES:
            out = out.when(body == name, value)
        return F.concat(out.when(body == "amp", "&").otherwise(F.concat(F.lit("&"), body, F.lit(";"))),
                        F.regexp_replace(x, r"^&[^;]*;", ""))
    # cut before every entity
    parts = F.split(c, r"(?i)(?=&(?:amp|quot|apos|lt|gt|#[0-9]{1,7}|#x[0-9a-f]{1,6});)")
    return F.array_join(F.transform(parts, lambda x: F.when(
        x.rlike(r"(?i)^&(?:amp|quot|apos|lt|gt|#[0-9]{1,7}|#x[0-9a-f]{1,6});"), one(x)).otherwise(x)), "")


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` parts resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), lambda acc, x: F.when(
        x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"),
                    F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolved(page: Column, to: Column) -> Column:
    """The absolute URL of a target ``to`` of a page, by RFC 3986; null for one that is
    relative to a page without ``://``."""
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own, rest = F.regexp_extract(to, r"^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    query = F.regexp_extract(page, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to) \
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string")) \
        .when(root == "", F.lit(None).cast("string")) \
        .when(to.startswith("//"), F.concat(scheme, to)) \
        .when(own == "", F.concat(root, path, F.when(rest.startswith("?"), rest).otherwise(F.concat(query, rest)))) \
        .when(own.startswith("/"), F.concat(root, without_dots(own), rest)) \
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))


#: What a browser does not read as tags; without its end it goes on to the page's end.
_HIDDEN = r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style|textarea|template)\b.*?(?:</\1\s*>|\z)"


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): URLs as given to where their page's canonical links and refresh
    redirects lead. Relative targets are resolved against the page's first ``<base href>``
    or else its URL; those of schemes without ``//`` lead nowhere. Tags inside comments,
    scripts, styles, text areas and templates do not count."""
    pages = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh|&#")) \
        .select("url", F.regexp_replace("html", _HIDDEN, " ").alias("html"))
    bases = F.filter(F.transform(F.regexp_extract_all("html", F.lit(_tag("base")), 0), lambda t: _attribute(t, "href")),
                     lambda x: x != "")

    def target(c: Column) -> Column:
        return F.trim(F.concat(*[F.regexp_extract(c, _TARGET, k) for k in (1, 2, 3)]))
    links = F.filter(F.regexp_extract_all("html", F.lit(_tag("link")), 0),
                     lambda t: _attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"))
    metas = F.filter(F.regexp_extract_all("html", F.lit(_tag("meta")), 0),
                     lambda t: _attribute(t, "http-equiv").rlike("(?i)^refresh$"))
    found = F.concat(F.transform(links, lambda t: _attribute(t, "href")),
                     F.transform(metas, lambda t: let(_attribute(t, "content"), target)))
    to = pages.select("url", F.when(F.col("html").rlike("(?i)<base"), F.get(bases, 0)).alias("base"),
                      F.explode(found).alias("to")).where("to != ''")
    page = F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url"))
    dst = resolved(F.col("page"), F.col("to"))
    return to.withColumn("page", page).select(F.col("url").alias("src"), dst.alias("dst")).where("dst is not null")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, decided_by) for every page (page_id, url,
    html); ``redirects`` (src, dst) adds further redirects as URLs.

    ``decided_by``: rule, alias (a decision reached the URL from its class) or default
    (allow). Null URLs and those without ``://`` have empty host and path; pages with
    a null URL are in no class. Repeated rows and null ids stay; an empty table gives
    no rows; null html has no links. URLs that differ only in scheme, fragment,
    tracking parameters or a final slash are one node, with the decisions of all of them.
    Targets that are no page's URL are nodes too.
    """
    judged = with_host_path(pages.select("page_id", "url", "html")).withColumn("own", rule_column(rules))
    rows = stage(judged.select("page_id", "host", "path", "own.rule", F.col("own.verdict").alias("own"),
                               canonical(F.col("url")).alias("node")), "judged")
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    edges = stage(edges.distinct(), "links")
    parts = connected_components(edges.select(canonical(F.col("src")).alias("src"), canonical(F.col("dst")).alias("dst")))
    # the rules of the URLs at the ends of edges, pages or not
    ends = edges.select(F.col("src").alias("url")).union(edges.select(F.col("dst").alias("url")))
    ends = with_host_path(ends).select(canonical(F.col("url")).alias("node"), rule_column(rules)["verdict"].alias("own"))
    # a node's own decision, then the class's: allow, else block (both map-side combined)
    votes = rows.select("node", "own").union(ends).where("node is not null").groupBy("node").agg(
        F.min("own").alias("own"))  # allow sorts before block
    known = votes.join(parts, "node", "full").withColumn("class", F.coalesce("component", "node"))
    of_class = known.groupBy("class").agg(F.min("own").alias("said")).where("said is not null")
    reach = stage(known.join(of_class, "class").select("node", "said"), "aliases")
    out = rows.join(reach, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "said", F.lit("allow")).alias("verdict"),
                      F.when(F.col("own").isNotNull(), "rule").when(F.col("said").isNotNull(), "alias")
                      .otherwise("default").alias("decided_by"))
