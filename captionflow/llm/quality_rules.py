"""Quality rules: distribution divergence from language references.

A document's histograms of character classes and of a language's common words are
compared with those of its language by the Jensen-Shannon distance (divergence in
bits, 0 to 1). A reference is the sum over all documents of a language. Documents
below a minimum length are not compared: their histograms are noise. Two plain rules
on length and repetition come first.

Built-in functions only; the texts are read once, into a few counts for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty
from .native import SPACE, let, non_empty

GRAM = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Fewest characters, and fewest words, for which histograms are compared.
MIN_CHARS_COMPARED = 300
MIN_WORDS_COMPARED = 60
#: Largest divergence of a kept document, in bits.
MAX_CHAR_DIVERGENCE = 0.05
MAX_WORD_DIVERGENCE = 0.25

# Common words of the languages.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los"),
}
N_COMMON = 8
CLASSES = ("lower", "space", "symbol", "upper", "digit", "other_script", "punctuation")


def _class_counts(text: Column) -> Column:
    """Characters of each class; each class is taken out of what the last one left."""
    out = [r"[a-z]+", rf"[{SPACE}]+", r"[#*$%&|<>]+", r"[A-Z]+", r"[0-9]+", r"[^\x00-\x7F]+"]

    def step(rest: Column, k: int, counts: list[Column]) -> Column:
        if k == len(out):
            return F.array(*counts, F.length(rest).cast("long"))
        return let(F.regexp_replace(rest, out[k], ""),
                   lambda less: step(less, k + 1, [*counts, (F.length(rest) - F.length(less)).cast("long")]))
    return step(text, 0, [])


def _repeat_words(words: Column) -> Column:
    """Words in windows of GRAM words that occur twice or more (the first included)."""
    def marked(pairs: Column) -> Column:  # (hash, place), sorted
        twice = F.filter(F.transform(pairs, lambda p, k: F.struct(p["i"].alias("i"), (
            F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False))
            | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))).alias("twice"))), lambda p: p["twice"])
        places = F.sort_array(F.transform(twice, lambda p: p["i"]))
        return let(places, lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(GRAM), F.coalesce(F.get(at, k + 1) - p, F.lit(GRAM)))),
            F.lit(0).cast("long"), lambda n, x: n + x))

    def of_hashes(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, marked))
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(words, i, GRAM)))
    return F.when(F.size(words) <= GRAM, F.lit(0).cast("long")).otherwise(let(windows, of_hashes))


def _common_counts(words: Column, lang: Column) -> Column:
    """Uses of each common word of the language; empty for unknown languages."""
    every = sorted({w for ws in COMMON.values() for w in ws})
    bare = F.filter(F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(".,;:!?\"'()"))), lambda w: w.isin(every))
    listed = F.array().cast("array<string>")
    for code, ws in COMMON.items():
        listed = F.when(lang == code, F.array(*[F.lit(w) for w in ws])).otherwise(listed)
    return let(bare, lambda own: F.transform(listed, lambda c: F.size(F.filter(own, lambda w: w == c)).cast("long")))


def measure(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, lang, the base counts and the histograms."""
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text_or_empty().alias("text"))
    cut = text.select("doc_id", "lang", "text", non_empty(F.split("text", f"[{SPACE}]+")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    dups = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    made = cut.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), _class_counts(F.col("text")).alias("classes"),
        dups.alias("n_dup_lines"), _repeat_words(F.col("words")).alias("n_repeat_words"),
        _common_counts(F.col("words"), F.col("lang")).alias("common"))
    k = {name: F.get("classes", F.lit(i)) for i, name in enumerate(CLASSES)}
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("*", (chars - k["space"]).alias("word_chars"), k["symbol"].alias("n_symbols"), chars.alias("n_chars"))


def language_references(measured: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): sums over all documents of a language, the
    last common count being the other words."""
    sums = measured.groupBy("lang").agg(
        *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))],
        *[F.sum(F.coalesce(F.get("common", F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(N_COMMON)],
        F.sum("n_words").alias("n"))
    common = [F.col(f"w{i}") for i in range(N_COMMON)]
    return sums.select("lang", F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))]).alias("ref_classes"),
                       F.array(*common, F.col("n") - sum(common[1:], common[0])).alias("ref_common"))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Divergence in bits between two count arrays of one length; 0 if one is empty."""
    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda n, v: n + v)

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def of(s: Column) -> Column:
        both = F.zip_with(a, b, lambda x, y: F.struct((x / s["a"]).alias("p"), (y / s["b"]).alias("q")))
        terms = F.transform(both, lambda r: 0.5 * part(r["p"], (r["p"] + r["q"]) / 2) + 0.5 * part(r["q"], (r["p"] + r["q"]) / 2))
        return F.when((s["a"] > 0) & (s["b"] > 0), total(terms)).otherwise(0.0)
    return let(F.struct(total(a).alias("a"), total(b).alias("b")), of)


def judge(docs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_divergence,
    word_divergence, kept. ``references`` (lang, ref_classes, ref_common) replace those
    of the documents themselves.

    Null and empty texts have counts 0 and fail the base rule. A null language is the
    language '' with a reference of its own; a language without a list of common words
    is compared by character classes alone. Divergences are 0 where a guard on length
    leaves a document out. Repeated rows and null ids stay; an empty table gives no
    rows; whole texts are read.
    """
    measured = stage(measure(docs), "measures")
    refs = language_references(measured) if references is None else references
    both = measured.join(refs, "lang", "left")
    own = F.concat("common", F.array(F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)))
    chars = F.when((F.col("n_chars") >= MIN_CHARS_COMPARED) & F.col("ref_classes").isNotNull(),
                   jensen_shannon(F.col("classes"), F.col("ref_classes"))).otherwise(0.0)
    words = F.when((F.col("n_words") >= MIN_WORDS_COMPARED) & (F.size("common") == N_COMMON) & F.col("ref_common").isNotNull(),
                   jensen_shannon(own, F.col("ref_common"))).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), chars.alias("char_divergence"), words.alias("word_divergence")) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("char_divergence") <= MAX_CHAR_DIVERGENCE)
                    & (F.col("word_divergence") <= MAX_WORD_DIVERGENCE))
