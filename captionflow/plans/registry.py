"""Registered queries: one per operator, each with its DuckDB oracle SQL.

Every query reads the given test tables through a fixture adapter
(:mod:`captionflow.sources.fixtures`) and runs the operator on all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import fixtures as X
from . import oracle_sql as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ============================================================== captions
def _captions(spark, sf_dir, **kw):
    from .captions import CaptionTables
    return CaptionTables(X.fx_cues(X.table(spark, sf_dir, "documents")), **kw)


@register("read_cues", O.sql("SELECT * FROM cues", "cues"))
def q_read_cues(spark, sf_dir):
    """FX-SRT round trip: cues written as caption files to the shared checkpoint folder,
    read back by the reader."""
    from ..sources.srt import read_cues, write_cues
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/srt-{uuid.uuid4().hex}"
    write_cues(X.fx_cues(X.table(spark, sf_dir, "documents")), path, prefix="chan-")
    return read_cues(spark, path)


@register("video_tiers", O.sql("SELECT * FROM tiers", "tiers"))
def q_video_tiers(spark, sf_dir):
    from ..operators.captions import video_tiers
    t = video_tiers(X.fx_cues(X.table(spark, sf_dir, "documents")))
    return t.select("video_id", "n_cues", "duration_s", "window_s", "threshold", "min_segments")


@register("strip_rollup", O.sql("SELECT video_id, seq, clean_text FROM cue_windows", "cue_windows"))
def q_strip_rollup(spark, sf_dir):
    return _captions(spark, sf_dir, materialize=False).cue_windows.select("video_id", "seq", "clean_text")


@register("strip_rollup_chunked", O.sql("SELECT video_id, seq, clean_text, win FROM cue_windows", "cue_windows"))
def q_strip_rollup_chunked(spark, sf_dir):
    """The fold of long videos, in chunks of 16 cues whose starts are guessed, for every
    video: the same texts and windows."""
    from ..operators.captions import clean_and_window_chunked
    cues = X.fx_cues(X.table(spark, sf_dir, "documents"))
    return clean_and_window_chunked(cues, chunk_cues=16, warm_cues=2).select("video_id", "seq", "clean_text", "win")


@register("adaptive_windows", O.sql("SELECT video_id, seq, start_ms, end_ms, win FROM cue_windows", "cue_windows"))
def q_adaptive_windows(spark, sf_dir):
    return _captions(spark, sf_dir, materialize=False).cue_windows.select("video_id", "seq", "start_ms", "end_ms",
                                                                          "win")


@register("window_text", O.sql("SELECT * FROM windows", "windows"))
def q_window_text(spark, sf_dir):
    return _captions(spark, sf_dir).windows.select("video_id", "lang", "win", "start_ms", "end_ms", "n_cues", "text")



@register("drop_stopwords", O.sql("""
SELECT a.video_id, a.win, a.n_tokens, CAST(coalesce(b.n_kept, 0) AS BIGINT) AS n_kept
FROM (SELECT video_id, win, count(*) AS n_tokens FROM _tok GROUP BY ALL) a
LEFT JOIN (SELECT video_id, win, sum(tf) AS n_kept FROM _tf GROUP BY ALL) b USING (video_id, win)""", "_tok", "_tf"))
def q_drop_stopwords(spark, sf_dir):
    """Per window: tokens before and after removing the language's stopwords."""
    from ..functions import scalars as S
    from ..operators import topics as T
    w = _captions(spark, sf_dir).windows
    toks = w.select("video_id", "win", S.stopword_key("lang").alias("swkey"),
                    F.explode(F.regexp_extract_all(F.lower("text"), F.lit(S.TOKEN_RE), 0)).alias("term"))
    kept = T.drop_stopwords(toks, T.stopword_table(spark))
    a = toks.groupBy("video_id", "win").agg(F.count(F.lit(1)).alias("n_tokens"))
    b = kept.groupBy("video_id", "win").agg(F.count(F.lit(1)).alias("n_kept"))
    return a.join(b, ["video_id", "win"], "left").select("video_id", "win", "n_tokens",
                                                         F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@register("tfidf", O.sql("SELECT video_id, win, term, tf, round(weight, 6) AS weight FROM tfidf", "tfidf"))
def q_tfidf(spark, sf_dir):
    return _captions(spark, sf_dir).tfidf.select("video_id", "win", "term", "tf", r6("weight"))


@register("adjacent_cosine", O.sql("SELECT video_id, win, round(sim, 6) AS sim FROM sims", "sims"))
def q_adjacent_cosine(spark, sf_dir):
    return _captions(spark, sf_dir).sims.select("video_id", "win", r6("sim"))


@register("topic_breaks", O.sql("SELECT * FROM breaks", "breaks"))
def q_topic_breaks(spark, sf_dir):
    return _captions(spark, sf_dir).breaks


@register("assign_segments", O.sql("SELECT * FROM segs", "segs"))
def q_assign_segments(spark, sf_dir):
    return _captions(spark, sf_dir).segs


@register("segment_keywords", O.sql("SELECT * FROM seg_keywords", "seg_keywords"))
def q_segment_keywords(spark, sf_dir):
    return _captions(spark, sf_dir).keywords


@register("segment_stats", O.sql("SELECT * FROM seg_stats", "seg_stats"))
def q_segment_stats(spark, sf_dir):
    return _captions(spark, sf_dir).stats


@register("segment_preview", O.sql("SELECT * FROM seg_preview", "seg_preview"))
def q_segment_preview(spark, sf_dir):
    return _captions(spark, sf_dir).preview


@register("segment_topics", O.sql("""
SELECT l.video_id, l.seg, st.start_ts, coalesce(k.keywords, '') AS keywords
FROM seg_list l JOIN seg_stats st USING (video_id, seg) LEFT JOIN seg_keywords k USING (video_id, seg)""",
                                  "seg_list", "seg_stats", "seg_keywords"))
def q_segment_topics(spark, sf_dir):
    """Flagship: topic segments with start time and TF-IDF keywords."""
    from .captions import segment_topics
    return segment_topics(X.fx_cues(X.table(spark, sf_dir, "documents")))


@register("topic_label", O.sql("SELECT video_id, seg, label FROM seg_table", "seg_table"))
def q_topic_label(spark, sf_dir):
    return _captions(spark, sf_dir).seg_table.select("video_id", "seg", "label")


@register("paragraphs", O.sql("SELECT * FROM paragraphs", "paragraphs"))
def q_paragraphs(spark, sf_dir):
    return _captions(spark, sf_dir).paragraphs()


@register("dedup_lines", O.sql("SELECT video_id, seg, para, CAST(length(text) AS INTEGER) AS n_chars, text FROM paragraphs",
                               "paragraphs"))
def q_dedup_lines(spark, sf_dir):
    """Paragraph bodies after roll-up line merging (same pass as ``paragraphs``)."""
    p = _captions(spark, sf_dir).paragraphs()
    return p.select("video_id", "seg", "para", F.length("text").alias("n_chars"), "text")


@register("render_markdown", O.sql("SELECT * FROM markdown", "markdown"))
def q_render_markdown(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    return _captions(spark, sf_dir).markdown(X.fx_videos(docs))


from . import registry_blocks, registry_files, registry_flows, registry_state, registry_stream  # noqa: E402,F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: O.finish(text) for name, text in ORACLE.items()}


@register("stopword_sets", O.sql(f"""
SELECT l.lang, l.swkey, count(*) AS n_terms
FROM (SELECT DISTINCT lang, {O.SWKEY.format(c='lang')} AS swkey FROM documents) l JOIN _sw s USING (swkey)
GROUP BY ALL""", "_sw"))
def q_stopword_sets(spark, sf_dir):
    """The stopword set each document language resolves to (unknown -> pt) and its size."""
    from ..functions import scalars as S
    from ..operators import topics as T
    langs = X.table(spark, sf_dir, "documents").select("lang").distinct()
    stop = T.stopword_table(spark).groupBy("swkey").agg(F.count(F.lit(1)).alias("n_terms"))
    return langs.select("lang", S.stopword_key("lang").alias("swkey")).join(F.broadcast(stop), "swkey") \
        .select("lang", "swkey", "n_terms")
