"""Channel sync as one Spark plan: the state operators composed in the order a
sync runs them (history -> listing -> upsert -> reverse import -> legacy flags ->
date filter -> work plan -> fetch outcomes -> summary)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import state as ST


@dataclass
class SyncResult:
    state: DataFrame          # merged channel state after the sync
    plan: DataFrame           # one action per video of the working set
    outcomes: DataFrame | None
    summary: DataFrame | None


def channel_sync(history: DataFrame, state: DataFrame, listing: DataFrame, files: DataFrame, *,
                 outcomes: DataFrame | None = None, legacy_logs: DataFrame | None = None,
                 channel_name: str | None = None, playlist: str | None = None, since: str | None = None,
                 audio_only: bool = False, convert: bool = True, as_of: str | None = None,
                 info: DataFrame | None = None, recovered: DataFrame | None = None, ignore_metadata: bool = False,
                 focus: DataFrame | None = None) -> SyncResult:
    """Run one channel sync.

    ``history``: merged local history (``merge_videos`` of every state/metadata
    source); ``state``: the channel's stored rows; ``listing``: raw listing lines
    ``(video_id, ord, title, upload_date, epoch_s)``; ``files``: inventory rows
    with ``video_id`` and ``path``; ``outcomes``: fetch results for the videos the
    plan fetches; ``legacy_logs``: ``(kind, video_id)`` rows. ``info``: parsed
    metadata files; ``recovered``: a second source for rows still unknown
    (``(video_id, title, date)``), left out with ``ignore_metadata``. ``focus``: ids
    that the work is confined to; one not in the state gets a default row.
    """
    listed = ST.fill_dates(ST.listing_rows(listing), history)
    target = ST.target_channel(listing, history)
    merged = ST.upsert_listing(state, listed, playlist)
    imported = ST.reverse_import(merged.select("video_id"), history, target, channel_name)
    # imported ids are not among the channel's own, and each occurs once in the history;
    # a document lists them after the channel's own, each in its source's order
    base = ST.conform(merged.drop("src").withColumnRenamed("ord", "_own"))
    full = base.unionByName(ST.conform(imported).withColumnRenamed("ord", "_imported").select(
        *[c for c in base.columns if c != "_own"], "_imported"), allowMissingColumns=True)
    full = full.withColumn("ord", F.struct(F.col("_own").isNull().alias("imported"), "_own", "_imported")).drop("_own", "_imported")
    if legacy_logs is not None:
        full = ST.apply_legacy_flags(full, legacy_logs).drop("flips")
    if info is not None:
        full = ST.harvest_metadata(full, info)
    if recovered is not None and not ignore_metadata:
        full = ST.heal_metadata(full, recovered).drop("healed")
    work = ST.focus_video(full, focus).drop("injected") if focus is not None else ST.filter_since(full, since)
    plan = ST.plan_work(work, ST.files_present(files), audio_only=audio_only, convert=convert)
    if outcomes is None:
        return SyncResult(full, plan, None, None)
    applied = ST.apply_outcomes(plan, outcomes, as_of, audio_only=audio_only)
    return SyncResult(full, plan, applied, ST.session_summary(applied))


def state_after(result: SyncResult) -> DataFrame:
    """The channel's state with the flags that the outcomes of its working set set."""
    if result.outcomes is None:
        return result.state
    flags = result.outcomes.select("video_id", *[F.col(f).alias(f"_{f}") for f in ST.FLAGS])
    return (result.state.join(flags, "video_id", "left")
            .withColumns({f: F.coalesce(f"_{f}", f) for f in ST.FLAGS}).drop(*[f"_{f}" for f in ST.FLAGS]))


def sync_folder(spark, folder: str, channel: str, history: DataFrame, listing: DataFrame, files: DataFrame, *,
                handle: str | None = None, tags: DataFrame | None = None, language: str | None = None,
                **options) -> SyncResult:
    """A channel sync from and to the channel's state document in ``folder``.

    The document is the one :func:`~captionflow.sources.state_files.pick_state_file` names.
    Its rows are the stored state; the language is ``language``, else the document's, else
    that of ``tags`` (channel, ord, tag), else the default; the state with its new flags is
    written as the document again (:func:`~captionflow.sources.sinks.write_channel_state`).
    So a sync can be run again from what it wrote. ``options`` go to :func:`channel_sync`.
    """
    from ..session import drop_staged, stage_table
    from ..sources.sinks import write_channel_state
    from ..sources.state_files import list_files, pick_state_file, read_channel_state

    here = folder.rstrip("/")
    picked = pick_state_file(list_files(spark, here).filter("dir = ''"), channel).first()
    file = picked["path"].rsplit("/", 1)[-1] if picked is not None and not picked["is_new"] else None
    if file is not None:
        rows = stage_table(read_channel_state(spark, f"{here}/{file}"), "stored-state")
        stored_lang = rows.agg(F.max("detected_language").alias("l")).first()["l"]
        state = rows.withColumn("ord", F.col("pos")).drop("path", "doc_channel", "detected_language", "pos")
    else:
        rows, stored_lang = None, None
        state = ST.conform(spark.createDataFrame([], "video_id string, ord long"))
    result = channel_sync(history, state, listing, files, **options)
    one = spark.createDataFrame([(channel, stored_lang)], "channel string, stored_lang string")
    if stored_lang is None:  # N/A: nothing stored
        one = one.withColumn("stored_lang", F.lit("N/A"))
    detected = ST.detect_language(tags.filter(F.col("channel") == channel)) if tags is not None \
        else spark.createDataFrame([], "channel string, lang string")
    lang = ST.resolve_language(one, detected, language).select(
        F.col("channel").alias("state_channel"), F.lit(handle).cast("string").alias("handle"), F.lit(file).cast("string").alias("file"),
        F.col("lang").alias("detected_language"))
    after = stage_table(state_after(result), "synced-state")
    write_channel_state(after.withColumn("state_channel", F.lit(channel)), lang, here)
    drop_staged(after)
    return result


def regen_markdown(spark, root: str, state: DataFrame | None = None, note: str | None = None) -> DataFrame:
    """Offline regeneration (:func:`regen_documents`) of the caption files in ``root``
    and ``root/archive``. The texts are joined once, with the files to convert, by the
    path."""
    from ..sources.state_files import list_files, plain_path
    raw = (spark.read.option("pathGlobFilter", "*.srt").option("recursiveFileLookup", "true")
           .text(root, wholetext=True).select(F.col("value").alias("srt"), plain_path(F.col("_metadata.file_path")).alias("uri")))
    return regen_documents(list_files(spark, root), raw, state, note)


def regen_documents(inventory: DataFrame, texts: DataFrame, state: DataFrame | None = None,
                    note: str | None = None) -> DataFrame:
    """Markdown fragments (``video_id`` is the file's path) for every caption file of
    ``inventory`` in the root folder or ``archive`` that has no Markdown file next
    to it; titles from the stored state (file stem when unknown), dates unknown.
    ``texts``: ``(uri, srt)`` of the inventory's files.

    Every caption file is a document of its own, keyed by its path: two languages of
    a video, or a file and its archive copy, are two documents. The id is the
    11-character run of the name, else the file stem."""
    from ..operators import files as FL
    from ..operators import transcript as TR
    from ..sources.srt import parse_srt
    from ..functions import scalars as S
    from .captions import CaptionTables

    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    srt = inventory.filter((F.col("ext") == "srt") & F.col("dir").isin(FL.ARCHIVE_DIR, "")) \
        .withColumn("video_id", F.coalesce(F.nullif("video_id", F.lit("")), stem)) \
        .withColumn("_stem", F.regexp_replace("path", r"\.srt$", ""))
    done = inventory.filter(F.col("ext") == "md").select(F.regexp_replace("path", r"\.md$", "").alias("_stem"))
    todo = srt.join(done, "_stem", "left_anti").select("uri", "path", "video_id", "name")
    cues = parse_srt(texts.join(todo, "uri").select("srt", F.col("path").alias("video_id"), S.extract_lang("name").alias("lang")))
    titles = (FL.lookup_titles(todo, state) if state is not None else todo.select("path", "video_id", stem.alias("title")))
    videos = titles.select(F.col("path").alias("video_id"), "title", F.lit(TR.UNKNOWN_DATE).alias("publish_date"),
                           F.col("video_id").alias("url_id"))
    t = CaptionTables(cues)
    return t.markdown(videos, note) if note else t.markdown(videos)
