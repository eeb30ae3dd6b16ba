"""Caption -> topic-segment plan (the flagship) and its intermediate tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import captions as C
from ..operators import topics as T
from ..operators import transcript as TR
from ..functions import scalars as S
from ..session import BY_BUCKET, CLUSTERED_JOINS, drop_staged, stage_buckets, stage_clustered, stage_table


@dataclass
class CaptionTables:
    """Lazily built intermediate tables of one caption run (each a DataFrame)."""
    cues: DataFrame
    elapsed: str = "total"
    native_lang: bool = False
    # Stage the tables that feed several branches (fold output, windows, TF-IDF,
    # segments) as parquet in the checkpoint folder: each branch then scans one
    # table instead of re-running a copy of the upstream plan, and a lost
    # executor never re-runs the Python fold. All of them are bucketed by video, as
    # the fold's one shuffle has dealt the cues: whatever is keyed by a video and
    # more (window, term, segment) needs no further shuffle.
    materialize: bool = True
    buckets: int | None = None
    # Videos of more cues than this are folded in chunks by several tasks (found by a
    # count of cues by video); none by default.
    long_cues: int | None = None

    def __post_init__(self):
        self._cache: dict[str, DataFrame] = {}
        if self.materialize:
            self.buckets = self.buckets or stage_buckets(self.cues)
            self.cues.sparkSession.conf.set(*CLUSTERED_JOINS)

    def _get(self, name, build, stage: bool = False):
        if name not in self._cache:
            df = build()
            if stage and self.materialize:
                df = stage_clustered(df, name, self.buckets, "video_id")
            self._cache[name] = df
        return self._cache[name]

    def cleanup(self) -> None:
        """Delete the staged tables of this run (call after its results are written)."""
        for df in self._cache.values():
            drop_staged(df)
        self._cache.clear()

    @property
    def tiers(self):
        # from the staged fold output: a partial+final aggregate of one scan
        return self._get("tiers", lambda: C.video_tiers(self.cue_windows))

    @property
    def _fold(self):
        def build():
            if self.long_cues is None:
                return C.clean_and_window(self.cues, elapsed=self.elapsed, partitions=self.buckets, windows=True)
            long = self._get("long_videos", lambda: stage_table(self.cues.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
                                                                .where(F.col("n") > self.long_cues).select("video_id"), "long-videos"))
            short = self.cues.join(long, "video_id", "left_anti")
            return C.clean_and_window(short, elapsed=self.elapsed, partitions=self.buckets).unionByName(
                C.clean_and_window_chunked(self.cues.join(long, "video_id", "left_semi"), elapsed=self.elapsed)
                .repartition(*([self.buckets] if self.buckets else []), "video_id"))
        return self._get("fold", build, stage=True)

    @property
    def cue_windows(self):
        return self._get("cue_windows", lambda: self._fold.select("video_id", "lang", "seq", "start_ms", "end_ms", "clean_text", "win"))

    @property
    def windows(self):
        # one per-video aggregate of the fold output gives the window count and
        # the tier values; one join puts them on every window row
        return self._get("windows", lambda: C.window_text(self._fold).join(
            self.tiers.select("video_id", "n_windows", "threshold", "min_segments").hint(BY_BUCKET), "video_id"), stage=True)

    @property
    def terms(self):
        return self._get("terms", lambda: T.window_terms(self.windows, self.native_lang, lists=True), stage=True)

    @property
    def norms(self):
        return self._get("norms", lambda: T.window_norms(self.terms))

    @property
    def tfidf(self):
        return self._get("tfidf", lambda: T.tfidf(self.terms, self.norms))

    @property
    def sims(self):
        return self._get("sims", lambda: T.adjacent_cosine(self.windows, self.norms))

    @property
    def breaks(self):
        return self._get("breaks", lambda: T.topic_breaks(self.windows, self.sims))

    @property
    def segs(self):
        return self._get("segs", lambda: T.assign_segments(self.breaks), stage=True)

    @property
    def vocab_videos(self):
        """Videos with at least one term; the others (stopwords only) give no output."""
        return self._get("vocab", lambda: self.norms.select("video_id").distinct())

    @property
    def rejects(self):
        return self._get("rejects", lambda: self.windows.select("video_id").distinct()
                         .join(self.vocab_videos, "video_id", "left_anti")
                         .withColumn("reason", F.lit("empty vocabulary")))

    @property
    def seg_list(self):
        return self._get("seg_list", lambda: self.segs.join(self.vocab_videos.select("video_id").hint(BY_BUCKET), "video_id", "left_semi")
                         .groupBy("video_id", "seg").agg(F.min("win").alias("first_win")))

    @property
    def keywords(self):
        return self._get("keywords", lambda: T.segment_keywords(self.terms, self.norms, self.segs))

    @property
    def stats(self):
        return self._get("stats", lambda: T.segment_stats(self.windows, self.segs, self.elapsed))

    @property
    def preview(self):
        return self._get("preview", lambda: T.segment_preview(self.windows, self.segs, native_lang=self.native_lang))


    @property
    def seg_table(self):
        """``(video_id, seg, start_ms, start_ts, duration, keywords, label, preview)``."""
        def build():
            return (self.seg_list.join(self.stats.select("video_id", "seg", "start_ms", "start_ts", "duration").hint(BY_BUCKET),
                                       ["video_id", "seg"])
                    .join(self.keywords.hint(BY_BUCKET), ["video_id", "seg"], "left")
                    .join(self.preview.hint(BY_BUCKET), ["video_id", "seg"], "left")
                    .select("video_id", "seg", "start_ms", "start_ts", "duration",
                            F.coalesce("keywords", F.lit("")).alias("keywords"),
                            S.topic_label("seg", "keywords").alias("label"),
                            F.coalesce("preview", F.lit("")).alias("preview")))
        return self._get("seg_table", build, stage=True)

    def paragraphs(self, terms: dict | None = None):
        return self._get(f"paragraphs{sorted((terms or {}).items())}",
                         lambda: TR.paragraphs(self.cue_windows, self.segs, self.elapsed, terms=terms))

    def markdown(self, videos: DataFrame, note: str = TR.DEFAULT_NOTE, terms: dict | None = None):
        """Ordered Markdown fragments per video (see :func:`render_markdown`)."""
        # videos without a term give no output: they go before the fold, where the rows are dealt by video
        segs = self.segs.join(self.vocab_videos.hint(BY_BUCKET), "video_id", "left_semi")
        paras = TR.paragraphs(self.cue_windows, segs, self.elapsed, terms=terms)
        return TR.render_markdown(videos, self.tiers, self.seg_table, paras, note, paras_fit=True)


def segment_topics(cues: DataFrame, elapsed: str = "total") -> DataFrame:
    """Flagship: ``(video_id, seg, start_ts, keywords)`` for every topic segment."""
    t = CaptionTables(cues, elapsed)
    # a segment starts at the first cue of its first window: the window table suffices
    start = (t.windows.join(t.segs.hint(BY_BUCKET), ["video_id", "win"]).groupBy("video_id", "seg")
             .agg(F.min_by("start_ms", "win").alias("start_ms")).select("video_id", "seg", S.smart_ts("start_ms")
                                                                       .alias("start_ts")))
    return (t.seg_list.join(start.hint(BY_BUCKET), ["video_id", "seg"])
            .join(t.keywords.hint(BY_BUCKET), ["video_id", "seg"], "left")
            .select("video_id", "seg", "start_ts", F.coalesce("keywords", F.lit("")).alias("keywords")))
