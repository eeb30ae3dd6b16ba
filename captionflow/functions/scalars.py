"""Column expressions (no Python UDFs): everything here stays inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stopwords as sw

# ---------------------------------------------------------------------------
# Fixed values (formats and patterns the outputs must reproduce)
# ---------------------------------------------------------------------------
TAG_RE = r"<[^>]+>"
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"          # = Python's \b\w\w+\b on this corpus
ALPHA_TERM_RE = r"^\p{L}{3,}$"
SENTENCE_END_RE = r"""[.!?]["']?\s*$"""
WATCH_URL = "https://youtube.com/watch?v="
WATCH_URL_WWW = "https://www.youtube.com/watch?v="
SITE_ROOT = "https://www.youtube.com/"
FENCE_LANGS = {"bash": "bash", "python": "python", "json": "json", "md": "markdown"}
PLAIN_TEXT = "plain text"
INTRO_LABEL = "Introdução"
TOPIC_LABEL = "Tópico"
KEYWORD_SEP = " · "
WEAK_DATES = ("", "N/A")
WEAK_TITLES = ("", "N/A", "Avulso")
INVALID_LANG_TAGS = ("na", "n/a", "none", "null", "undefined")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_tags(c) -> Column:
    """newline -> space, drop ``<...>`` tags, trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), "\n", " "), TAG_RE, ""))


def collapse_ws(c, spaces_only: bool = False) -> Column:
    """Runs of whitespace (or only of spaces) -> one space."""
    return F.regexp_replace(_c(c), " {2,}" if spaces_only else r"\s+", " ")


def replace_terms(c, terms: dict | None = None) -> Column:
    """Ordered literal replacements; null stays null."""
    out = _c(c)
    for old, new in (terms or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def upper_first(c) -> Column:
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def ends_sentence(c) -> Column:
    return _c(c).rlike(SENTENCE_END_RE)


def digits(n: Column, width: int) -> Column:
    """A whole number as ``%0<width>d`` formats it (a null as ``null``), for two or three
    digits: without a formatter, which is made anew for each value."""
    text = F.coalesce(n.cast("string"), F.lit("null"))
    out = text
    for k in range(1, width):
        out = F.when(n.between(0 if k == 1 else 10 ** (k - 1), 10 ** k - 1), F.concat(F.lit("0" * (width - k)), text)).otherwise(out)
    if width == 3:
        out = F.when(n.between(-9, -1), F.concat(F.lit("-0"), (-n).cast("string"))).otherwise(out)
    return out


def hms(ms) -> Column:
    """``HH:MM:SS`` of a millisecond count, milliseconds dropped."""
    s = F.floor(_c(ms) / 1000).cast("long")
    parts = (F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), (s % 60).cast("long"))
    return F.concat_ws(":", *[digits(x, 2) for x in parts])


def smart_ts(ms) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from one hour on."""
    s = F.floor(_c(ms) / 1000).cast("long")
    h = F.floor(s / 3600).cast("long")
    m = F.floor((s % 3600) / 60).cast("long")
    sec = (s % 60).cast("long")
    return F.concat_ws(":", F.when(h > 0, digits(h, 2)), digits(m, 2), digits(sec, 2))


def elapsed_s(end_ms, start_ms, mode: str = "total") -> Column:
    """Whole seconds between two times; ``component`` keeps only the 0-59 part."""
    d = F.floor((_c(end_ms) - _c(start_ms)) / 1000).cast("long")
    return F.pmod(d, F.lit(60)) if mode == "component" else d


def topic_label(seg, keywords) -> Column:
    seg, kw = _c(seg), _c(keywords)
    has_kw = kw.isNotNull() & (kw != "")
    return (F.when(seg == 1, F.when(has_kw, F.concat(F.lit(INTRO_LABEL + " — "), kw)).otherwise(F.lit(INTRO_LABEL)))
            .otherwise(F.when(has_kw, kw).otherwise(F.concat(F.lit(TOPIC_LABEL + " "), seg.cast("string")))))


def is_alpha_term(c) -> Column:
    return _c(c).rlike(ALPHA_TERM_RE)


def video_url(c, www: bool = False) -> Column:
    return F.concat(F.lit(WATCH_URL_WWW if www else WATCH_URL), _c(c))


def parse_lang_regex(c) -> Column:
    """``^pt$`` -> ``pt``."""
    return F.btrim(_c(c), F.lit("^$"))


def clean_lang_tag(c) -> Column:
    """Lowercase; invalid tags -> null; cut at ``-`` then ``_``."""
    low = F.lower(F.trim(_c(c)))
    cut = F.split(F.split(low, "-", 2)[0], "_", 2)[0]
    return F.when(low.isin(*INVALID_LANG_TAGS) | (low == ""), F.lit(None)).otherwise(cut)


def stopword_key(lang, native_lang: bool = False) -> Column:
    """Which stopword set a caption language uses (unknown -> ``pt``)."""
    prefix = F.substring(F.coalesce(_c(lang), F.lit(sw.DEFAULT_LANG)), 1, 2)
    known = sw.PARITY_LANGS + (("fr", "de") if native_lang else ())
    return F.when(prefix.isin(*known), prefix).otherwise(F.lit(sw.DEFAULT_LANG))


def classify_line(c) -> Column:
    """Markdown line kind (on the trimmed line)."""
    s = _c(c)
    return (F.when(s.startswith("# "), "heading_1")
            .when(s.startswith("## "), "heading_2")
            .when(s.startswith("### "), "heading_3")
            .when(s.startswith("* ") | s.startswith("- ") | s.startswith("• "), "bulleted_list_item")
            .when(s == "---", "divider")
            .otherwise("paragraph"))


def line_body(c, kind) -> Column:
    """The text after the block marker."""
    s, k = _c(c), _c(kind)
    return (F.when(k == "heading_1", F.substring(s, 3, 1 << 30))
            .when(k == "heading_2", F.substring(s, 4, 1 << 30))
            .when(k == "heading_3", F.substring(s, 5, 1 << 30))
            .when(k == "bulleted_list_item", F.substring(s, 3, 1 << 30))
            .when(k == "divider", F.lit(""))
            .otherwise(s))


def fence_language(c) -> Column:
    s = F.trim(_c(c))
    out = F.lit(PLAIN_TEXT)
    for k, v in reversed(list(FENCE_LANGS.items())):
        out = F.when(s == k, F.lit(v)).otherwise(out)
    return out


def is_weak_date(c) -> Column:
    c = _c(c)
    return c.isNull() | c.isin(*WEAK_DATES)


def is_weak_title(c) -> Column:
    c = _c(c)
    return c.isNull() | c.isin(*WEAK_TITLES)


def normalize_date(raw, epoch_s=None, strict: bool = False) -> Column:
    """Listing date: any 8 chars -> ``YYYY-MM-DD``; else the Unix time (UTC) when
    the raw date is empty; else ``N/A``. ``strict`` (metadata files): only 8
    digits are reformatted, other non-empty strings pass through, empty -> null."""
    r = _c(raw).cast("string")
    fmt = F.concat_ws("-", F.substring(r, 1, 4), F.substring(r, 5, 2), F.substring(r, 7, 2))
    if strict:
        return F.when(r.rlike(r"^[0-9]{8}$"), fmt).when(r == "", F.lit(None)).otherwise(r)
    raw8 = r
    if epoch_s is not None:
        from_epoch = F.date_format(F.timestamp_seconds(_c(epoch_s).cast("long")), "yyyyMMdd")
        raw8 = F.when(r.isNull() | (r == ""), from_epoch).otherwise(r)
    return F.when(F.length(raw8) == 8, F.concat_ws("-", F.substring(raw8, 1, 4), F.substring(raw8, 5, 2),
                                                   F.substring(raw8, 7, 2))).otherwise(F.lit("N/A"))


def coalesce_title(*cols, default: str = "N/A") -> Column:
    """First non-empty title, else ``default``."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols], F.lit(default))


def channel_key(url) -> Column:
    """URL -> grouping key: ``@handle`` name; ``playlist_<id>``; ``video_<id>``; else ``canal``."""
    u = _c(url)
    vid = F.regexp_extract(u, r"(?:v=|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    handle = F.regexp_extract(u, r"@([A-Za-z0-9_-]+)", 1)
    plist = F.regexp_extract(u, r"list=([A-Za-z0-9_-]+)", 1)
    is_video = u.contains("watch?v=") | u.contains("youtu.be/")
    return (F.when(is_video, F.concat(F.lit("video_"), F.when(vid != "", vid).otherwise(F.lit("video"))))
            .when(u.contains("@"), F.when(handle != "", handle).otherwise(F.lit("canal")))
            .when(u.contains("list="), F.concat(F.lit("playlist_"), F.when(plist != "", plist).otherwise(F.lit("playlist"))))
            .otherwise(F.lit("canal")))


def listing_url(url) -> Column:
    """Append ``/videos`` to a channel URL unless it is a video, a playlist or a tab."""
    u = _c(url)
    tab = u.endswith("/videos") | u.endswith("/shorts") | u.endswith("/streams") | u.endswith("/live")
    keep = u.contains("watch?v=") | u.contains("playlist?list=") | tab
    return F.when(keep, u).otherwise(F.concat(F.regexp_replace(u, "/+$", ""), F.lit("/videos")))


def classify_input(c) -> Column:
    """User input -> ``struct(url, kind, video_id)``."""
    s = _c(c)
    is_http = s.startswith("http")
    video_like = s.contains("watch?v=") | s.contains("youtu.be/")
    bare_id = s.rlike(r"^[A-Za-z0-9_-]{11}$")
    video_url_ = F.when(is_http, s).otherwise(F.concat(F.lit(WATCH_URL_WWW), s))
    site_url = F.when(is_http, s).otherwise(F.concat(F.lit(SITE_ROOT), s))
    vid_from_url = F.regexp_extract(video_url_, r"(?:v=|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    url = (F.when(video_like, video_url_).when(bare_id, F.concat(F.lit(WATCH_URL_WWW), s)).otherwise(site_url))
    kind = (F.when(video_like | bare_id, F.lit("video"))
            .when(s.contains("playlist?list="), F.lit("playlist")).otherwise(F.lit("channel")))
    vid = F.when(video_like, vid_from_url).when(bare_id, s).otherwise(F.lit(""))
    return F.struct(url.alias("url"), kind.alias("kind"), vid.alias("video_id"))


def extract_video_id(stem, mode: str = "suffix") -> Column:
    """11-char id from a file stem. ``suffix``: the run right before an optional
    language/extension suffix; ``leftmost``: the first 11-char run (parity)."""
    s = _c(stem)
    if mode == "leftmost":
        return F.regexp_extract(s, r"([A-Za-z0-9_-]{11})", 1)
    return F.regexp_extract(s, r"([A-Za-z0-9_-]{11})(?:[.-][A-Za-z]{2}(?:[-_][A-Za-z]{2})?)?(?:\.info)?$", 1)


def extract_lang(name) -> Column:
    """``-xx`` or ``-xx-XX`` before ``.srt`` (lowercased); default ``pt``."""
    m = F.regexp_extract(_c(name), r"-([a-z]{2}(-[A-Z]{2})?)\.srt$", 1)
    return F.when(m == "", F.lit("pt")).otherwise(F.lower(m))


def maturity_gate(date_col, as_of, min_days: int = 7) -> Column:
    """True when more than ``min_days`` whole days old, or the date is unknown."""
    d = F.try_to_date(_c(date_col), "yyyy-MM-dd")
    return F.coalesce(F.datediff(_c(as_of), d) > min_days, F.lit(True))


def chunk_text(c, size: int = 2000) -> Column:
    """Pieces of at most ``size`` characters (empty string -> empty array)."""
    s = _c(c)
    n = F.length(s)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")),
                    lambda i: F.substring(s, i * size + 1, size)))


RICH_TOKEN_RE = r"(\*\*.*?\*\*|`.*?`|[^*`]+)"


def rich_text_spans(c, terms: dict | None = None, size: int = 2000) -> Column:
    """``**bold**``, `` `code` `` and plain runs -> ``array<struct<content, bold, code>>``.

    Stray single markers are dropped by the token pattern; empty pieces dropped;
    ``replace_terms`` applied; each piece cut at ``size`` characters."""
    toks = F.regexp_extract_all(_c(c), F.lit(RICH_TOKEN_RE), 1)

    def piece(t):
        is_bold = t.startswith("**") & t.endswith("**") & (F.length(t) >= 2)
        is_code = ~is_bold & t.startswith("`") & t.endswith("`")
        body = (F.when(is_bold, F.substring(t, 3, 1 << 30).substr(F.lit(1), F.greatest(F.length(t) - 4, F.lit(0))))
                .when(is_code, F.substring(t, 2, 1 << 30).substr(F.lit(1), F.greatest(F.length(t) - 2, F.lit(0))))
                .otherwise(t))
        body = replace_terms(body, terms)
        return F.transform(chunk_text(F.coalesce(body, F.lit("")), size),
                           lambda p: F.struct(p.alias("content"), is_bold.alias("bold"), is_code.alias("code")))

    return F.flatten(F.transform(toks, piece))
