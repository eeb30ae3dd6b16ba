"""Per-video TF-IDF, adjacent similarity, topic breaks, segments and labels.

All of it is work keyed by ``(video_id, ...)``: no ML vectors, no all-pairs similarity
(only window ``i`` against ``i-1``). What counts or ranks words (terms, keywords, first
words of a segment) runs in Arrow and numpy over batches of whole videos or segments, a
row a window: no call of Python for a word, and no word that is a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import scalars as S
from ..functions import stopwords as sw
from ..session import BY_BUCKET

SIM_DECIMALS = 9          # similarity / score rounding before compare and rank


def stopword_table(spark, native_lang: bool = False) -> DataFrame:
    """Fixed-size lookup ``(swkey, term)``; a few thousand rows, safe to broadcast."""
    return F.broadcast(sw.stopword_sets(spark, native_lang).withColumnRenamed("lang", "swkey"))


def drop_stopwords(tokens: DataFrame, stop: DataFrame, term_col: str = "term") -> DataFrame:
    """Remove terms that are in the row's stopword set (broadcast anti join)."""
    s = stop.withColumnRenamed("term", term_col)
    return tokens.join(F.broadcast(s), ["swkey", term_col], "left_anti")


def without_stopwords(words, lang, native_lang: bool = False):
    """An array's words of more than one character that are not in the stopword set of a
    language (sets as literals). The set is chosen once a row, not once a word."""
    key, out = S.stopword_key(lang, native_lang), None
    for k in sorted({k for k, _ in sw.stopword_rows(native_lang)}):
        terms = sorted(t for q, t in sw.stopword_rows(native_lang) if q == k)
        kept = F.filter(words, lambda x: (F.length(x) > 1) & ~F.lower(x).isin(terms))
        out = F.when(key == k, kept) if out is None else out.when(key == k, kept)
    return out


#: A row of a window's terms (``lists``), beside its video and number.
TERM_LISTS = "terms array<string>, tfs array<bigint>, idfs array<double>, norm double, dot double"


def _ends(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where a row differs from the row before in one of the columns (nulls are alike)."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy()
    return new


def by_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows in the order of ``keys`` as tables of whole groups (equal keys), each
    with the number of its group for every row. Only a group that goes on over batches is held."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if len(held) > 1 and all(held[-1][k][-1].as_py() == held[0][k][0].as_py() for k in keys):
            continue  # the batch is all of the group before
        rows = pa.concat_tables(held).combine_chunks()
        new = _ends(*(rows[k] for k in keys))
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield rows.slice(0, last), np.cumsum(new[:last])
        held = [rows.slice(last)]
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        yield rows, np.cumsum(_ends(*(rows[k] for k in keys)))


def _flat(rows: pa.Table, column: str) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column, and for each the row that it is of."""
    lists = pc.fill_null(pc.list_value_length(rows[column]), 0).to_numpy()
    return pc.list_flatten(rows[column].combine_chunks()), np.repeat(np.arange(rows.num_rows), lists)


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Strings as numbers, and the strings that these stand for."""
    found = values.dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _lists(values: pa.Array, rows: np.ndarray, n: int) -> pa.ListArray:
    """Values in the order of their rows as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _term_fold(stop: dict[str, list[str]], win_type: pa.DataType, before: bool):
    """Rows (video_id, win, n_windows, swkey, tokens) of whole videos in the order of their
    windows -> ``TERM_LISTS`` of the windows with a term; ``before`` adds ``prev_tfs``."""
    def counted(rows: pa.Table, video: np.ndarray) -> pa.RecordBatch:
        n, wins = rows.num_rows, rows["win"].to_numpy().astype(np.int64)
        tokens, at = _flat(rows, "tokens")
        codes, words = _coded(tokens)
        swkey, keys = _coded(rows["swkey"].combine_chunks())
        stopped = np.array([pc.is_in(words, value_set=pa.array(stop.get(k, []), pa.string())).to_numpy(zero_copy_only=False)
                            for k in keys.to_pylist()], bool).reshape(len(keys), len(words))
        kept = ~stopped[swkey[at], codes]
        size = max(len(words), 1)
        each, tf = np.unique(at[kept] * size + codes[kept], return_counts=True)
        row, code = each // size, each % size
        # by (video, term), windows in their order
        pair = video[row] * size + code
        order = np.argsort(pair, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = pair[order][1:] != pair[order][:-1]
        starts = np.flatnonzero(first)
        df = np.empty(len(order), np.int64)
        df[order] = np.repeat(np.diff(np.append(starts, len(order))), np.diff(np.append(starts, len(order))))
        prev = np.zeros(len(order), np.int64)
        follows = ~first[1:] & (wins[row[order[1:]]] - 1 == wins[row[order[:-1]]])
        prev[order[1:][follows]] = tf[order[:-1][follows]]
        idf = np.log((rows["n_windows"].to_numpy()[row] + 1) / (df + 1)) + 1
        weight = tf * idf
        norm = np.sqrt(np.bincount(row, weight * weight, n))
        dot, shared = np.bincount(row, weight * prev * idf, n), np.bincount(row, prev, n) > 0
        have = np.flatnonzero(np.bincount(row, minlength=n))
        nth = np.searchsorted(have, row)
        out = {"video_id": rows["video_id"].take(have).combine_chunks(), "win": rows["win"].take(have).combine_chunks().cast(win_type),
               "terms": _lists(words.take(pa.array(code)), nth, len(have)), "tfs": _lists(pa.array(tf, pa.int64()), nth, len(have)),
               "idfs": _lists(pa.array(idf), nth, len(have)), "norm": pa.array(norm[have]), "dot": pa.array(dot[have], mask=~shared[have])}
        if before:
            out["prev_tfs"] = _lists(pa.array(prev, pa.int64(), mask=prev == 0), nth, len(have))
        return pa.RecordBatch.from_pydict(out)

    def fold(batches):
        for rows, video in by_groups(batches, ("video_id",)):
            yield counted(rows, video)
    return fold


def window_terms(windows: DataFrame, native_lang: bool = False, lists: bool = False) -> DataFrame:
    """``(video_id, win, term, tf, idf, prev_tf)``: the terms of each window, their counts
    there and in the window before (null if not in it).

    tokens = lowercase runs of 2+ word characters; idf = ln((1+n)/(1+df)) + 1 with
    n = all windows of the video (also those left without terms).

    ``lists`` gives a row a window with a term, ``(video_id, win, TERM_LISTS)``: its terms,
    their counts and idf as arrays, the length of its vector and the product with that of the
    window before. Windows are sorted by video, once; words are numbered and counted by
    Arrow and numpy over whole videos, so no term is a row that is sorted, joined or grouped.
    """
    w_in = windows if "n_windows" in windows.columns else with_window_count(windows)
    stop: dict[str, list[str]] = {}
    for key, term in sw.stopword_rows(native_lang):
        stop.setdefault(key, []).append(term)
    # a window function asks the planner for whole videos in order: rows that are dealt by video stay
    in_order = F.row_number().over(Window.partitionBy("video_id").orderBy("win"))
    toks = w_in.select(
        "video_id", "win", F.col("n_windows").cast("long").alias("n_windows"), S.stopword_key("lang", native_lang).alias("swkey"),
        "text", in_order.alias("nth")).select(
        "video_id", "win", "n_windows", "swkey", F.regexp_extract_all(F.lower("text"), F.lit(S.TOKEN_RE), 0).alias("tokens"), "nth")
    kind = windows.schema["win"].dataType
    found = toks.mapInArrow(_term_fold(stop, to_arrow_type(kind), before=not lists),
                            f"video_id string, win {kind.simpleString()}, {TERM_LISTS}" + ("" if lists else ", prev_tfs array<bigint>"))
    if lists:
        return found
    return found.select("video_id", "win", F.inline(F.arrays_zip(
        F.col("terms").alias("term"), F.col("tfs").alias("tf"), F.col("idfs").alias("idf"), F.col("prev_tfs").alias("prev_tf"))))


def window_norms(terms: DataFrame) -> DataFrame:
    """``(video_id, win, norm, dot)`` of the windows with a term: length of the window's
    vector, and its product with that of the window before over their shared terms. Terms
    as lists have both."""
    if "norm" in terms.columns:
        return terms.select("video_id", "win", "norm", "dot")
    w = F.col("tf") * F.col("idf")
    return terms.groupBy("video_id", "win").agg(
        F.sqrt(F.sum(w * w)).alias("norm"), F.sum(w * F.col("prev_tf") * F.col("idf")).alias("dot"))


def tfidf(terms: DataFrame, norms: DataFrame) -> DataFrame:
    """``(video_id, win, term, tf, weight)``: per-video smooth TF-IDF, L2-normalised, of
    :func:`window_terms` and their :func:`window_norms` (a row a window)."""
    if "norm" in terms.columns:
        each = F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"), F.col("idfs").alias("idf"))
        return terms.select("video_id", "win", "norm", F.inline(each)).select(
            "video_id", "win", "term", "tf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))
    return (terms.join(norms.select("video_id", "win", "norm").hint(BY_BUCKET), ["video_id", "win"])
            .select("video_id", "win", "term", "tf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight")))


def with_window_count(windows: DataFrame) -> DataFrame:
    """Add ``n_windows`` (windows of the video) via a per-video count join."""
    n = windows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_windows"))
    return windows.join(n, "video_id")


def adjacent_cosine(windows: DataFrame, norms: DataFrame) -> DataFrame:
    """``(video_id, win, sim)`` for win >= 1: cosine of each window with the previous.

    The product over shared terms is in ``norms`` (no self-join of the terms); it is
    divided by the lengths of both windows. Windows without shared terms (or without
    any term) get 0.
    """
    before = norms.select("video_id", (F.col("win") + 1).alias("win"), F.col("norm").alias("prev_norm"))
    wins = windows.select("video_id", "win").filter(F.col("win") >= 1)
    return (wins.join(norms.hint(BY_BUCKET), ["video_id", "win"], "left")
            .join(before.hint(BY_BUCKET), ["video_id", "win"], "left")
            .select("video_id", "win", F.round(F.coalesce(F.col("dot") / (F.col("norm") * F.col("prev_norm")), F.lit(0.0)),
                                               SIM_DECIMALS).alias("sim")))


def topic_breaks(windows: DataFrame, sims: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """``(video_id, win, is_break)`` for every window.

    Break = window 0, or sim < tier threshold, or among the ``min_segments-1``
    lowest similarities (ties by window index). Tier values come from
    ``windows`` when it carries them, else from ``tiers``. The rank and the
    segment count after it ride on one clustering by video: a video's windows
    are few beside its cues, which the fold has already held in one task.
    """
    w = windows.select("video_id", "win", *[c for c in ("threshold", "min_segments") if c in windows.columns])
    if "threshold" not in w.columns:
        w = w.join(tiers.select("video_id", "threshold", "min_segments"), "video_id")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("sim").asc_nulls_last(), "win"))
    return (w.join(sims.hint(BY_BUCKET), ["video_id", "win"], "left").withColumn("rk", rank)
            .select("video_id", "win",
                    ((F.col("win") == 0) | F.coalesce(F.col("sim") < F.col("threshold"), F.lit(False))
                     | (F.col("sim").isNotNull() & (F.col("rk") <= F.greatest(F.col("min_segments") - 1, F.lit(1)))))
                    .alias("is_break")))


def assign_segments(breaks: DataFrame) -> DataFrame:
    """``(video_id, win, seg)``: running count of breaks, segment ids from 1."""
    so_far = Window.partitionBy("video_id").orderBy("win").rowsBetween(Window.unboundedPreceding, 0)
    return breaks.select("video_id", "win", F.sum(F.col("is_break").cast("long")).over(so_far).alias("seg"))


def _rounded(x: np.ndarray) -> np.ndarray:
    """Numbers as ``round(x, SIM_DECIMALS)`` orders them: in units of the last decimal, a
    half (as the number is printed) away from zero."""
    unit = 10 ** SIM_DECIMALS
    y = x * unit
    out = np.floor(y + 0.5)
    for k in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-3):
        out[k] = int((Decimal(repr(float(x[k]))) * unit).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _keyword_fold(top_n: int, seg_type: pa.DataType):
    """Rows (video_id, seg, terms, tfs, idfs, norm) of whole segments -> their keywords."""
    def best(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        terms, at = _flat(rows, "terms")
        codes, words = _coded(terms)
        size = max(len(words), 1)
        part = _flat(rows, "tfs")[0].to_numpy() * _flat(rows, "idfs")[0].to_numpy() / rows["norm"].to_numpy()[at]
        # \p{L}{3,}: words of letters only
        fit = (pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False) & (pc.utf8_length(words).to_numpy() > 2))[codes]
        each, where = np.unique(group[at][fit] * size + codes[fit], return_inverse=True)
        score = np.bincount(where, part[fit], len(each))
        each, score = each[score > 0], score[score > 0]
        of, code = each // size, each % size
        rank = np.empty(size, np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        order = np.lexsort((rank[code], -_rounded(score), of))
        of, code = of[order], code[order]
        starts = np.searchsorted(of, of)
        top = np.arange(len(of)) - starts < top_n
        of, code = of[top], code[top]
        groups, nth = np.unique(of, return_inverse=True)
        row = np.searchsorted(group, groups)
        return pa.RecordBatch.from_arrays(
            [rows["video_id"].take(row).combine_chunks(), rows["seg"].take(row).combine_chunks().cast(seg_type),
             pc.binary_join(_lists(words.take(pa.array(code)), nth, len(groups)), S.KEYWORD_SEP)], ["video_id", "seg", "keywords"])

    def fold(batches):
        for rows, group in by_groups(batches, ("video_id", "seg")):
            yield best(rows, group)
    return fold


def segment_keywords(terms: DataFrame, norms: DataFrame, segs: DataFrame, top_n: int = 3) -> DataFrame:
    """``(video_id, seg, keywords)``: top terms by summed TF-IDF weight in the segment.

    Only alphabetic terms longer than 2 characters with a positive score; ties by
    the score rounded to 9 decimals, then term ascending. Joined by `` · ``. Terms as lists
    are summed and ranked by numpy over whole segments, a row a window; of terms as rows,
    segment and norm of a window are joined first: the terms pass one join.
    """
    if "norm" in terms.columns:
        kind = segs.schema["seg"].dataType
        # a window function asks the planner for whole segments: rows that are dealt by video stay
        in_order = F.row_number().over(Window.partitionBy("video_id").orderBy("seg", "win"))
        placed = terms.join(segs.hint(BY_BUCKET), ["video_id", "win"]).select(
            "video_id", "seg", "terms", "tfs", "idfs", "norm", in_order.alias("nth"))
        return placed.mapInArrow(_keyword_fold(top_n, to_arrow_type(kind)), f"video_id string, seg {kind.simpleString()}, keywords string")
    placed = segs.join(norms.select("video_id", "win", "norm").hint(BY_BUCKET), ["video_id", "win"])
    sc = (terms.filter(S.is_alpha_term("term")).join(placed.hint(BY_BUCKET), ["video_id", "win"])
          .groupBy("video_id", "seg", "term").agg(F.sum(F.col("tf") * F.col("idf") / F.col("norm")).alias("score"))
          .filter(F.col("score") > 0))
    w = Window.partitionBy("video_id", "seg").orderBy(F.col("rounded").desc(), "term")
    top = (sc.withColumn("rounded", F.round("score", SIM_DECIMALS)).withColumn("rk", F.row_number().over(w))
           .filter(F.col("rk") <= top_n))
    # the first row sees the others in the same order: no lists to collect by segment
    kws = F.concat_ws(S.KEYWORD_SEP, "term", *[f"t{k}" for k in range(1, top_n)])
    return (top.select("video_id", "seg", "rk", "term", *[F.lead("term", k).over(w).alias(f"t{k}") for k in range(1, top_n)])
            .filter(F.col("rk") == 1).select("video_id", "seg", kws.alias("keywords")))


def segment_stats(windows: DataFrame, segs: DataFrame, elapsed: str = "total") -> DataFrame:
    """``(video_id, seg, start_ms, end_ms, n_cues, start_ts, duration)``.

    Over all cues of the segment's windows, as the windows tell them: start of the first,
    end of the last (file order), count; duration ``~N min`` with N = max(1,
    round-half-even(s/60)), ``~1 min`` under two cues.
    """
    g = windows.select("video_id", "win", "start_ms", "end_ms", "n_cues").join(segs.hint(BY_BUCKET), ["video_id", "win"]) \
        .groupBy("video_id", "seg").agg(
            F.min_by("start_ms", "win").alias("start_ms"), F.max_by("end_ms", "win").alias("end_ms"),
            F.sum("n_cues").alias("n_cues"))
    secs = S.elapsed_s("end_ms", "start_ms", elapsed)
    mins = F.greatest(F.lit(1), F.bround(secs / 60.0, 0).cast("long"))
    dur = F.when(F.col("n_cues") < 2, F.lit("~1 min")).otherwise(F.concat(F.lit("~"), mins.cast("string"), F.lit(" min")))
    return g.select("video_id", "seg", "start_ms", "end_ms", "n_cues",
                    S.smart_ts("start_ms").alias("start_ts"), dur.alias("duration"))


def _preview_fold(max_words: int, seg_type: pa.DataType):
    """Rows (video_id, seg, kept) of whole segments, in order -> their first words."""
    def first(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        words, at = _flat(rows, "kept")
        n = int(group[-1]) + 1
        row = np.searchsorted(group, np.arange(n))
        starts = np.searchsorted(group[at], np.arange(n + 1))
        have = np.diff(starts)
        nth = np.arange(len(at)) - starts[group[at]]
        shown = nth < max_words
        text = pc.binary_join(_lists(words.filter(pa.array(shown)), group[at][shown], n), " ")
        more = pa.array(np.where(have > max_words, "...", "").tolist(), pa.string())
        return pa.RecordBatch.from_arrays(
            [rows["video_id"].take(row).combine_chunks(), rows["seg"].take(row).combine_chunks().cast(seg_type),
             pc.binary_join_element_wise(text, more, "")], ["video_id", "seg", "preview"])

    def fold(batches):
        for rows, group in by_groups(batches, ("video_id", "seg")):
            yield first(rows, group)
    return fold


def segment_preview(windows: DataFrame, segs: DataFrame, max_words: int = 12,
                    native_lang: bool = False) -> DataFrame:
    """``(video_id, seg, preview)``: first words of the segment text that are not
    stopwords and longer than one character; ``...`` when more remain."""
    # each window keeps its first kept words only, as an array; a window without one is gone
    kept = F.slice(without_stopwords(F.split(F.trim("text"), r"\s+"), "lang", native_lang), 1, max_words + 1)
    words = (windows.select("video_id", "win", kept.alias("kept")).filter(F.size("kept") > 0)
             .join(segs.hint(BY_BUCKET), ["video_id", "win"]))
    kind = segs.schema["seg"].dataType
    in_order = F.row_number().over(Window.partitionBy("video_id").orderBy("seg", "win"))
    return words.select("video_id", "seg", "kept", in_order.alias("nth")).mapInArrow(
        _preview_fold(max_words, to_arrow_type(kind)), f"video_id string, seg {kind.simpleString()}, preview string")
