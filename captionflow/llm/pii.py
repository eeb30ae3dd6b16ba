"""Personal data by weak supervision.

Labelers of three sorts vote on candidate spans: regular expressions (a strict and a
loose one, with a check of form or checksum), gazetteers (domain endings, calling
codes, card issuers, address ranges) and the words before a span. A vote is yes, no
or none. Expectation-maximisation estimates, for each kind of data, how often each
labeler votes yes or no on true and on false candidates, without labels; its
posteriors train a final logistic span classifier, which also sees a span's size and
what borders on it. The strict expression's spans are always reported; the classifier
decides about the others.

Built-in functions only. Votes are counted by pattern (a bounded number of patterns)
before anything reaches the driver; the trained models are column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty
from .native import found, let, piece, running, span_text, text_blocks

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
#: Characters before a span that the context labeler reads.
CONTEXT = 24

# The strict expressions. A look-behind keeps a match from being tried
# at every character of a long run; \G lets one follow the match before it.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    # runs that hold every chain of 14 digits or more; chains are cut out of them
    "card": r"[0-9][\x20\x2D0-9]{12,}[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Loose expressions: further candidates, also inside stretches the strict ones drop.
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}"
              r"(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])(?:[0-9]{4}[\x20-]?){3}[0-9]{2,7}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?\(?(?<![0-9])[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "de", "fr", "es", "uk", "it", "nl",
           "eu", "ch", "at", "be", "pt", "br", "mx", "ar", "us", "ca", "au", "jp", "cn", "in")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
                 "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
                 "90", "91", "351", "353", "358", "420")
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|36|30[0-5]|6011|65|35)"
CUES = {
    "email": "e-?mail|contact|write|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|client|login|addr",
    "card": "card|visa|master|amex|credit|payment|carte|karte|tarjeta",
    "phone": r"phone|call|mobile|\btel\b|fax|cell|whatsapp|telefon|tel\.",
}
DOUBTS = r"version|\bv\.?$|isbn|issn|order|invoice|serial|sku|build|section|chapter"
VOTERS = ("strict", "loose", "form", "gazetteer", "context")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    from_right = F.transform(F.sequence(F.lit(0), F.length(digits) - 1),
                             lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int"))
    worth = F.transform(from_right, lambda d, i: F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return (F.length(digits) > 0) & (F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _part_ok(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _span(start: Column, kind: int, hit: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"),
                    (start + F.length(hit)).cast("int").alias("end"), hit.alias("hit"))


_NONE = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _card_chains(text: Column) -> Column:
    """(start, hit) of the chains of digits, at most one blank or hyphen between two."""
    def of_run(r: Column) -> Column:
        return F.transform(_chains(r["hit"]), lambda x: F.struct((r["start"] + x["start"]).alias("start"), x["hit"].alias("hit")))
    return F.flatten(F.transform(found(text, STRICT["card"]), of_run))


def _chains(run: Column) -> Column:
    """(start, hit) of what double separators leave of a run."""
    # the second and later separators of a row mark the cuts; each keeps its place
    pieces = F.split(run, r"(?<=[\x20-])(?=[\x20-])", -1)

    def place(own: Column) -> Column:
        ends = running(F.transform(own, F.length), F.lit(0), lambda a, x: a + x)
        return F.zip_with(own, ends, lambda p, end: F.struct(
            (end - F.length(F.ltrim(p, F.lit(" -")))).alias("start"), F.btrim(p, F.lit(" -")).alias("hit")))
    return let(pieces, place)


def _strict_ok(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), _part_ok)
    if kind == "card":
        return let(_digits(hit), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _spans(text: Column, loose: bool) -> list[Column]:
    """The strict or the loose spans of each kind, by start; none overlaps another."""
    digit = text.rlike("[0-9]")
    some = {"email": text.contains("@") if not loose else text.rlike(r"[\[(]\x20?at\x20?[\])]"),
            "ip": digit if not loose else text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": digit,
            "phone": text.contains("+") if not loose else digit}
    parts = []
    for k, kind in enumerate(KINDS):
        if loose:
            hits = found(text, LOOSE[kind])
        elif kind == "card":
            hits = _card_chains(text)
        else:
            hits = found(text, STRICT[kind])
        if not loose:
            hits = F.filter(hits, lambda x: _strict_ok(kind, x["hit"]))
        spans = F.transform(hits, lambda x: _span(x["start"], k, x["hit"]))
        parts.append(F.when(some[kind], spans).otherwise(F.array().cast(_NONE)))
    return parts


def _met(strict: Column, loose: Column) -> Column:
    """The spans of one kind by both expressions, in order, with ``strict`` (which of them
    found it) and ``met`` (whether one of the other overlaps). Both come in order and
    without overlaps, so a span is met if the other's spans that start before it reach
    over its start, or the next of the other's starts before its end."""
    def tagged(spans: Column, which: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                     F.lit(which).alias("strict"), s["hit"].alias("hit")))

    def with_met(spans: Column, met: Callable[[Column, Column], Column]) -> Column:
        return F.transform(spans, lambda s, i: F.struct(*[s[n].alias(n) for n in ("start", "kind", "end", "strict", "hit")],
                                                        met(s, i).alias("met")))

    def merged(m: Column) -> Column:
        def reach(which: bool) -> Column:
            return running(F.transform(m, lambda s: F.when(s["strict"] == which, s["end"]).otherwise(-1)), F.lit(-1), F.greatest)

        def following(which: bool) -> Column:
            far = 2**31 - 1
            starts = F.reverse(F.transform(m, lambda s: F.when(s["strict"] == which, s["start"]).otherwise(far)))
            return F.reverse(running(starts, F.lit(far), F.least))
        of = F.struct(*[f(w).alias(f"{f.__name__}_{int(w)}") for f in (reach, following) for w in (False, True)])
        return let(of, lambda o: with_met(m, lambda s, i: F.when(
            s["strict"], (F.get(o["reach_0"], i) > s["start"]) | (F.get(o["following_0"], i) < s["end"])).otherwise(
            (F.get(o["reach_1"], i) > s["start"]) | (F.get(o["following_1"], i) < s["end"]))))
    both = F.concat(tagged(strict, True), tagged(loose, False))
    return F.when((F.size(strict) > 0) & (F.size(loose) > 0), let(F.array_sort(both), merged)) \
        .otherwise(with_met(both, lambda s, i: F.lit(False)))


# ---------------------------------------------------------------- votes
def _by_kind(span: Column, of: dict[str, Column]) -> Column:
    out = F.lit(None).cast("int")
    for k, kind in enumerate(KINDS):
        out = F.when(span["kind"] == k, of[kind]).otherwise(out)
    return out


def _yes_no(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def _votes(blocks: Column, span: Column, strict: Column, loose: Column) -> Column:
    """The span with the votes of all labelers (1 yes, 0 no, null none) and features."""
    hit, digits = span["hit"], _digits(span["hit"])
    ending = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
    form = _by_kind(span, {
        "email": _yes_no(ending.rlike("^[a-z]{2,24}$")),
        "ip": _yes_no(hit.contains(":") | (F.forall(F.split(hit, r"\."), _part_ok) & ~hit.rlike(r"(^|\.)0[0-9]"))),
        "card": _yes_no(F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)),
        "phone": _yes_no(F.length(digits).between(10, 15))})
    gazetteer = _by_kind(span, {
        "email": _yes_no(ending.isin(*DOMAINS)),
        "ip": _yes_no(hit.contains(":") | ~hit.rlike(r"^(0|[0-9]\.[0-9]\.[0-9]\.[0-9]$|22[4-9]|2[345][0-9])")),
        "card": _yes_no(digits.rlike(ISSUERS)),
        "phone": F.when(hit.startswith("+"), _yes_no(F.regexp_extract(hit, r"^\+([0-9]{1,3})", 1).rlike(
            "^(" + "|".join(CALLING_CODES) + ")")))})
    before = F.lower(piece(blocks, F.greatest(span["start"] - CONTEXT, F.lit(0)), F.least(span["start"], F.lit(CONTEXT))))
    cue = _by_kind(span, {kind: F.when(before.rlike(CUES[kind]), 1) for kind in KINDS})
    context = F.coalesce(cue, F.when(before.rlike(DOUBTS), 0))
    next_to = piece(blocks, span["end"], F.lit(1))
    return F.struct(
        span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end"),
        F.when(strict, 1).alias("strict"), F.when(loose, 1).alias("loose"), form.alias("form"),
        gazetteer.alias("gazetteer"), context.alias("context"),
        F.least(F.length(hit) / 8, F.lit(4)).cast("int").alias("size"),
        _yes_no(before.rlike(r"[\p{L}0-9]$")).alias("glued_before"), _yes_no(next_to.rlike(r"[\p{L}0-9]")).alias("glued_after"))


def candidates(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, base (the strict spans) and others (the loose
    spans that no strict span of their kind overlaps), each with votes, by start, then
    kind. Time grows with the text and, a little faster, with its spans."""
    t = F.col("text")
    kinds = [_met(F.col(f"b{k}"), F.col(f"l{k}")) for k in range(len(KINDS))]
    spans = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id", "text", *[c.alias(f"{name}{k}") for name, loose in (("b", False), ("l", True))
                            for k, c in enumerate(_spans(t, loose))]) \
        .select("doc_id", "text", F.concat(*kinds).alias("spans"))

    def with_votes(blocks: Column) -> Column:
        def of(found_by: str) -> Column:
            chosen = F.filter("spans", lambda s: s["strict"] if found_by == "strict" else ~s["strict"] & ~s["met"])
            votes = F.transform(chosen, lambda s: _votes(blocks, s, s["strict"], ~s["strict"] | s["met"]))
            return F.array_sort(votes)
        return F.struct(of("strict").alias("base"), of("loose").alias("others"))
    blocks = F.when(F.size("spans") > 0, text_blocks(t)).otherwise(F.array().cast("array<string>"))
    return spans.select("doc_id", let(blocks, with_votes).alias("v")).select("doc_id", "v.base", "v.others")


# ---------------------------------------------------------------- models
def estimate_reliabilities(patterns: list[tuple[tuple, int]], rounds: int = 200) -> tuple[float, list[dict], list[dict]]:
    """Expectation-maximisation over vote patterns (votes, count): the share of true
    candidates and, for each labeler, how often it gives each vote on true and on
    false ones. The strict expression's votes set the start; nothing is labelled."""
    total = sum(n for _, n in patterns)
    k = len(patterns[0][0])
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(1 if v == 1 else -1 if v == 0 else 0 for v in votes))) for votes, _ in patterns]
    prior, yes, no = 0.5, [], []
    for _ in range(rounds):
        prior = (sum(p * n for p, (_, n) in zip(post, patterns)) + 1) / (total + 2)
        yes, no = [], []
        for j in range(k):
            for out, share in ((yes, post), (no, [1 - p for p in post])):
                mass = {v: 0.5 for v in (1, 0, None)}
                for p, (votes, n) in zip(share, patterns):
                    mass[votes[j]] += p * n
                whole = sum(mass.values())
                out.append({v: m / whole for v, m in mass.items()})
        # a labeler is never read the wrong way round
        for y, n in zip(yes, no):
            if y[1] * (n[0] + n[1]) < n[1] * (y[0] + y[1]):
                mean = {v: (y[v] + n[v]) / 2 for v in y}
                y.update(mean)
                n.update(mean)
        after = [posterior(votes, prior, yes, no) for votes, _ in patterns]
        moved = max(abs(a - b) for a, b in zip(after, post))
        post = after
        if moved < 1e-6:
            break
    return prior, yes, no


def posterior(votes: tuple, prior: float, yes: list[dict], no: list[dict]) -> float:
    z = math.log(prior / (1 - prior)) + sum(math.log(y[v] / n[v]) for v, y, n in zip(votes, yes, no))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _inputs(kind: int, votes: tuple, size: int, before: int, after: int) -> list[float]:
    """Features of the span classifier: by kind a constant, a yes and a no for each
    labeler but the strict one, then size and neighbours."""
    row = [0.0] * (len(KINDS) * (2 * (len(VOTERS) - 1) + 1) + 7)
    at = kind * (2 * (len(VOTERS) - 1) + 1)
    row[at] = 1.0
    for j, v in enumerate(votes[1:]):
        if v is not None:
            row[at + 1 + 2 * j + (0 if v == 1 else 1)] = 1.0
    tail = len(KINDS) * (2 * (len(VOTERS) - 1) + 1)
    row[tail + min(max(size, 0), 4)] = 1.0
    row[tail + 5], row[tail + 6] = float(before), float(after)
    return row


def train_classifier(rows: list[tuple[list[float], float, int]], steps: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic weights from (features, soft label, count) by gradient steps."""
    if not rows:
        return []
    total, w = sum(n for *_, n in rows), [0.0] * len(rows[0][0])
    used = [([i for i, v in enumerate(x) if v], y, n / total) for x, y, n in rows]
    for _ in range(steps):
        grad = [1e-4 * v for v in w]
        for on, y, n in used:
            z = max(-30.0, min(30.0, sum(w[i] for i in on)))
            g = n * (1 / (1 + math.exp(-z)) - y)
            for i in on:
                grad[i] += g
        w = [v - rate * 4 * g for v, g in zip(w, grad)]
    return w


def fit(cands: DataFrame) -> list[float]:
    """The span classifier's weights, from all candidates: their vote patterns are
    counted by Spark; at most a few thousand distinct patterns reach the driver."""
    names = ["kind", *VOTERS, "size", "glued_before", "glued_after"]
    counted = cands.select(F.explode(F.concat("base", "others")).alias("s")).select(*[F.col("s")[n].alias(n) for n in names]) \
        .groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()
    rows = []
    for kind in range(len(KINDS)):
        own = [r for r in counted if r["kind"] == kind]
        by_votes: dict[tuple, int] = {}
        for r in own:
            votes = tuple(r[v] for v in VOTERS)
            by_votes[votes] = by_votes.get(votes, 0) + r["n"]
        if not by_votes:
            continue
        prior, yes, no = estimate_reliabilities(sorted(by_votes.items(), key=repr))
        rows += [(_inputs(kind, tuple(r[v] for v in VOTERS), r["size"], r["glued_before"], r["glued_after"]),
                  posterior(tuple(r[v] for v in VOTERS), prior, yes, no), r["n"]) for r in own]
    return train_classifier(rows)


def probability(span: Column, w: list[float]) -> Column:
    """The classifier as a column over a span with votes; 0 if nothing was trained."""
    if not w:
        return F.lit(0.0)
    width = 2 * (len(VOTERS) - 1) + 1
    tail = len(KINDS) * width
    z = F.lit(0.0)
    for k in range(len(KINDS)):
        own = F.lit(w[k * width])
        for j, v in enumerate(VOTERS[1:]):
            own = own + F.when(span[v] == 1, w[k * width + 1 + 2 * j]).when(span[v] == 0, w[k * width + 2 + 2 * j]).otherwise(0.0)
        z = z + F.when(span["kind"] == k, own).otherwise(0.0)
    z = z + F.get(F.array(*[F.lit(x) for x in w[tail:tail + 5]]), span["size"])
    z = z + span["glued_before"] * w[tail + 5] + span["glued_after"] * w[tail + 6]
    return 1 / (1 + F.exp(-z))


def scan_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card,
    n_phone (strict spans), base_spans and spans as ``kind:start:end`` strings in code
    points, by start, then kind.

    Null and empty texts have no spans; repeated rows and null ids are scanned one by
    one; an empty table gives no rows and trains nothing; whole texts are read, other
    columns are not.
    """
    cands = stage(candidates(docs), "candidates")
    weights = fit(cands)

    def plain(spans):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    added = F.filter("others", lambda s: probability(s, weights) >= threshold)
    every = F.array_sort(F.concat(plain(F.col("base")), plain(added)))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return cands.select("doc_id", *counts, span_text(plain(F.col("base")), KINDS).alias("base_spans"),
                        span_text(every, KINDS).alias("spans"))
