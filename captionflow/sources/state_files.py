"""Readers for state documents, listings, per-video metadata, legacy logs and
file inventories. Each ``parse_*`` works on a text column (so it applies to any
text DataFrame); each ``read_*`` is the file source built on it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..session import stage_table
from .ranges import RANGE_BYTES, file_ranges, folder_entries, json_records, whole_files

VIDEO_FIELDS = T.StructType([
    T.StructField("video_id", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("publish_date", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("subtitle_downloaded", T.BooleanType()), T.StructField("info_downloaded", T.BooleanType()),
    T.StructField("has_no_subtitle", T.BooleanType()), T.StructField("playlists", T.ArrayType(T.StringType())),
    T.StructField("channel_id", T.StringType()), T.StructField("uploader", T.StringType()),
    T.StructField("uploader_id", T.StringType()), T.StructField("duration_s", T.DoubleType()),
    T.StructField("channel", T.StringType()), T.StructField("view_count", T.LongType()),
])
STATE_DOC = T.StructType([T.StructField("channel", T.StringType()),
                          T.StructField("detected_language", T.StringType()),
                          T.StructField("videos", T.ArrayType(VIDEO_FIELDS))])
LISTING_LINE = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
                             T.StructField("fulltitle", T.StringType()), T.StructField("upload_date", T.StringType()),
                             T.StructField("timestamp", T.LongType())])
INFO_DOC = T.StructType([T.StructField(n, T.StringType()) for n in (
    "upload_date", "publish_date", "date", "title", "fulltitle", "video_title", "channel_id", "uploader_id",
    "uploader", "channel", "_bad")] + [T.StructField("subtitle_downloaded", T.BooleanType()),
                                       T.StructField("duration", T.DoubleType()),
                                       T.StructField("view_count", T.LongType())])

# ---------------------------------------------------------------------------
# Names of the existing state files, legacy log files and the
# kind each log records; they must match the files the tool already wrote.
# ---------------------------------------------------------------------------
LEGACY_LOGS = {"historico.txt": "subtitle", "historico-info.txt": "info", "videos_sem_legenda.txt": "no_subtitle"}
STATE_PREFIXES = ("state_", "lista_")   # neutral defaults: modern prefix, legacy prefix; pass your own
BLACKLIST = ("package.json", "package-lock.json", "requirements.json", "env.json")
SKIP_DIRS = (".git", ".venv", "__pycache__")


def _opts():
    return {"mode": "PERMISSIVE"}


# ------------------------------------------------------------------ listings
def parse_listing_lines(lines: DataFrame, text_col: str = "value", ord_col: str = "ord",
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines -> ``(video_id, *keep, ord, title, fulltitle, upload_date, epoch_s)``;
    unparsable lines and lines without ``id`` are skipped."""
    j = F.from_json(F.col(text_col), LISTING_LINE, _opts())
    return (lines.select(*keep, F.col(ord_col).alias("ord"), j.alias("j"))
            .filter(F.col("j.id").isNotNull() & (F.col("j.id") != ""))
            .select(F.col("j.id").alias("video_id"), *keep, "ord", F.col("j.title").alias("title"),
                    F.col("j.fulltitle").alias("fulltitle"), F.col("j.upload_date").alias("upload_date"),
                    F.col("j.timestamp").alias("epoch_s")))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listing files (JSON lines), split like any text file. ``ord`` is the order key
    ``(file, block, line)``: the file, the start of the split that holds the line, and the
    line's place among those its task reads. It orders lines as they stand in the files
    and is unique over all of them."""
    f = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                          F.monotonically_increasing_id().alias("line")).alias("ord"))
    return parse_listing_lines(f.withColumn("file", F.col("ord.file")), keep=("file",))


# ------------------------------------------------------------------ state documents
def parse_state_documents(docs: DataFrame, text_col: str = "doc", path_col: str = "path") -> DataFrame:
    """State JSON in either shape (object with ``videos`` or a bare list) ->
    ``(path, doc_channel, detected_language, pos, video_id, ...)``; key ``video_id``
    else ``id``; unreadable documents give no rows."""
    obj = F.from_json(F.col(text_col), STATE_DOC, _opts())
    arr = F.from_json(F.col(text_col), T.ArrayType(VIDEO_FIELDS), _opts())
    d = docs.select(F.col(path_col).alias("path"), obj.alias("o"), arr.alias("a"))
    vids = F.coalesce(F.col("o.videos"), F.col("a"))
    return _state_rows(d.select("path", F.col("o.channel").alias("doc_channel"),
                                F.col("o.detected_language").alias("detected_language"),
                                F.posexplode(vids).alias("pos", "v")))


def _state_rows(rows: DataFrame) -> DataFrame:
    """(path, doc_channel, detected_language, pos, v) with the fields of ``v`` as columns."""
    return (rows.select("path", "doc_channel", "detected_language", F.col("pos").cast("long").alias("pos"),
                        F.coalesce(F.nullif(F.col("v.video_id"), F.lit("")), F.nullif(F.col("v.id"), F.lit("")))
                        .alias("video_id"),
                        *[F.col(f"v.{c}").alias(c) for c in VIDEO_FIELDS.fieldNames() if c not in ("video_id", "id")])
            .filter(F.col("video_id").isNotNull()))


def read_channel_state(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """State documents (``*.json``) of a folder, or one: the rows of
    :func:`parse_state_documents`. A document is read by byte ranges and each video's
    object is a row of its own, so a document may be of any size; ``pos`` counts the
    objects of its list. A document that breaks off gives no rows."""
    found = stage_table(json_records(file_ranges(spark, path, ".json", range_bytes), "videos", ("channel", "detected_language")),
                        "state-documents")
    rows = found.where("field = 'videos'")
    ahead = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")) \
        .select("file", "start", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("base"))
    heads = found.where("field <> 'videos'").groupBy("file").agg(_last_string("channel"), _last_string("detected_language"))
    return (rows.join(base, ["file", "start"]).join(heads, "file", "left")
            .select(F.col("file").alias("path"), F.col("channel").alias("doc_channel"), "detected_language",
                    (F.col("base") + F.col("nth")).alias("pos"), F.from_json("json", VIDEO_FIELDS, _opts()).alias("v"))
            .transform(_state_rows))


# ------------------------------------------------------------------ per-video metadata
def parse_video_info(docs: DataFrame, text_col: str = "doc", name_col: str = "name",
                     id_mode: str = "suffix", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per-video metadata JSON -> state rows; id from the file name; date and
    title chains; ``info_downloaded`` = a date is present; non-objects and
    malformed documents are skipped."""
    m = F.from_json(F.col(text_col), INFO_DOC, {**_opts(), "columnNameOfCorruptRecord": "_bad"})
    is_obj = F.trim(F.col(text_col)).startswith("{")
    stem = F.regexp_replace(F.col(name_col), r"(\.info)?\.json$", "")
    d = docs.filter(is_obj).select(*keep, S.extract_video_id(stem, id_mode).alias("video_id"), m.alias("m"))
    raw_date = F.coalesce(*[F.nullif(F.col(f"m.{c}"), F.lit("")) for c in ("upload_date", "publish_date", "date")])
    date = S.normalize_date(raw_date, strict=True)
    return (d.filter((F.col("video_id") != "") & F.col("m").isNotNull() & F.col("m._bad").isNull()).select(
        *keep, "video_id",
        S.coalesce_title("m.title", "m.fulltitle", "m.video_title", default="Avulso").alias("title"),
        F.coalesce(date, F.lit("N/A")).alias("publish_date"),
        F.coalesce(F.col("m.subtitle_downloaded"), F.lit(False)).alias("subtitle_downloaded"),
        date.isNotNull().alias("info_downloaded"),
        F.lit(False).alias("has_no_subtitle"),
        F.coalesce(F.nullif(F.col("m.channel_id"), F.lit("")), F.col("m.uploader_id")).alias("channel_id"),
        F.coalesce(F.nullif(F.col("m.uploader"), F.lit("")), F.col("m.channel")).alias("uploader"),
        F.coalesce(F.nullif(F.col("m.uploader_id"), F.lit("")), F.col("m.channel_id")).alias("uploader_id")))


def read_state_heads(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, channel, detected_language) of the state documents of a folder; the file's
    name. Documents that are bare lists have neither."""
    found = json_records(file_ranges(spark, path, ".json", range_bytes), "", ("channel", "detected_language")) \
        .where("field <> ''")
    return found.groupBy(F.regexp_extract("file", r"([^/]*)$", 1).alias("file")).agg(
        _last_string("channel"), _last_string("detected_language"))


def _last_string(field: str) -> Column:
    """The last value of a document's field, if it is a string that is not empty."""
    own = F.when(F.col("field") == field, F.col("json"))
    last = F.max_by(own, F.when(own.isNotNull(), F.struct("start", "nth")))
    return F.nullif(F.get_json_object(F.concat(F.lit('{"v":'), last, F.lit("}")), "$.v"), F.lit("")).alias(field)


def read_video_info(spark: SparkSession, path: str, id_mode: str = "suffix") -> DataFrame:
    """Per-video metadata files (:func:`parse_video_info`) of a folder, a file or an address
    with wildcards, listed and read by tasks: their number is not limited by the driver."""
    return parse_video_info(whole_files(spark, path).select(F.col("text").alias("doc"), "name"), id_mode=id_mode)


# ------------------------------------------------------------------ legacy logs
def parse_log_lines(lines: DataFrame, text_col: str = "value", file_col: str = "file",
                    logs: dict | None = None) -> DataFrame:
    """Legacy text logs -> distinct ``(kind, video_id)``. Id logs hold
    ``youtube <id>`` lines; the no-caption log holds URLs with ``watch?v=<id>``. A log
    is a file of its name, or a folder of that name with ``part-`` files."""
    logs = logs or LEGACY_LOGS
    kind = F.lit(None).cast("string")
    for name, k in reversed(list(logs.items())):
        kind = F.when(F.regexp_extract(F.col(file_col), r"([^/]+?)(?:/part-[^/]*)?$", 1) == name, F.lit(k)).otherwise(kind)
    s = F.trim(F.col(text_col))
    vid = (F.when((kind != "no_subtitle") & s.startswith("youtube "), F.substring(s, 9, 1 << 30))
           .when((kind == "no_subtitle") & s.contains("watch?v="),
                 F.trim(F.element_at(F.split(s, r"watch\?v="), -1))))
    return (lines.select(kind.alias("kind"), vid.alias("video_id"))
            .filter(F.col("kind").isNotNull() & F.col("video_id").isNotNull() & (F.col("video_id") != ""))
            .distinct())


def read_legacy_logs(spark: SparkSession, path: str, logs: dict | None = None) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_log_lines(lines, logs=logs)


# ------------------------------------------------------------------ file inventories
def describe_files(files: DataFrame, path_col: str = "path", mtime_col: str = "mtime_s",
                   id_mode: str = "suffix") -> DataFrame:
    """Inventory rows -> ``(path, dir, name, ext, video_id, lang, mtime_s)``, and
    ``uri`` where the rows have one."""
    p = F.col(path_col)
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"(\.info)?\.[A-Za-z0-9]+$", "")
    return files.select(
        p.alias("path"), F.regexp_extract(p, r"^(.*)/[^/]*$", 1).alias("dir"), name.alias("name"),
        F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"),
        S.extract_video_id(stem, id_mode).alias("video_id"),
        S.extract_lang(name).alias("lang"), F.col(mtime_col).alias("mtime_s"),
        *(["uri"] if "uri" in files.columns else []))


def list_files(spark: SparkSession, root: str, exts=("srt", "md", "json")) -> DataFrame:
    """Files of ``root`` and its direct sub-folders (except tool folders): path, folder
    (relative to ``root``), name, id, language, extension, mtime. Tasks list the folders,
    two levels and no deeper; contents are not read; empty files count. ``uri`` is the
    path, as :func:`plain_path` gives it for a file that Spark reads."""
    at = re.sub(r"^file:/+", "/", root).rstrip("/")
    top = folder_entries(spark.createDataFrame([(at,)], "dir string"))
    below = top.where(F.col("is_dir") & ~F.col("name").isin(*SKIP_DIRS)).select(F.col("path").alias("dir"))
    found = top.union(folder_entries(below.repartition(spark.sparkContext.defaultParallelism, "dir")))
    files = found.where(~F.col("is_dir") & F.regexp_extract("name", r"\.([^.]*)$", 1).isin(*exts))
    # folders relative to the root: "" for the root itself, e.g. "archive" below it
    return describe_files(files.select("path", "mtime_s", F.col("path").alias("uri"))) \
        .withColumn("dir", F.substring("dir", len(at) + 2, 1 << 30))


def plain_path(address: Column) -> Column:
    """The path of Spark's file metadata, with its escapes undone, without ``file:``."""
    return F.regexp_replace(F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def route_state_files(files: DataFrame, prefixes=STATE_PREFIXES, blacklist=BLACKLIST) -> DataFrame:
    """JSON files -> ``route``: ``state`` (prefixed), ``metadata`` (an 11-char id
    in the name), else ``ignore``; blacklisted names dropped."""
    name = F.col("name")
    is_state = F.lit(False)
    for p in prefixes:
        is_state = is_state | name.startswith(p)
    return (files.filter((F.col("ext") == "json") & ~name.isin(*blacklist))
            .withColumn("route", F.when(is_state, "state")
                        .when(name.rlike(r"[A-Za-z0-9_-]{11}"), "metadata").otherwise("ignore")))


def latest_file(files: DataFrame, channel: str | None = None, by: str = "dir",
                prefixes=STATE_PREFIXES) -> DataFrame:
    """Per folder: the state file to use. With ``channel``: the exact modern name,
    else the exact legacy name. Without: newest modern file; legacy files only
    when no modern one exists."""
    name = F.col("name")
    if channel:
        rank = (F.when(name == f"{prefixes[0]}{channel}.json", 0)
                .when(name == f"{prefixes[1]}{channel}.json", 1))
        cand = files.withColumn("_r", rank).filter(F.col("_r").isNotNull())
        return cand.groupBy(by).agg(F.min_by("path", "_r").alias("path"), F.min_by("name", "_r").alias("name"))
    tier = F.when(name.startswith(prefixes[0]), 0).when(name.startswith(prefixes[1]), 1)
    cand = files.filter(F.col("ext") == "json").withColumn("_t", tier).filter(F.col("_t").isNotNull())
    best_tier = cand.groupBy(by).agg(F.min("_t").alias("_bt"))
    c = cand.join(best_tier, by).filter(F.col("_t") == F.col("_bt"))
    key = F.struct(F.col("mtime_s"), F.col("path"))
    return c.groupBy(by).agg(F.max_by("path", key).alias("path"), F.max_by("name", key).alias("name"))


def pick_state_file(files: DataFrame, channel: str, by: str = "dir", prefixes=STATE_PREFIXES) -> DataFrame:
    """Per folder, the state file a channel sync reads and rewrites: the exact
    modern name; else the folder's only state file (modern files, legacy ones
    only when no modern exists); else the first by path whose name contains the
    channel; else the newest. A folder without state files gets a new file
    (``is_new``). One aggregate per folder; no ordering of whole folders."""
    name = F.col("name")
    target = f"{prefixes[0]}{channel}.json"
    tier = F.when(name.startswith(prefixes[0]), 0).when(name.startswith(prefixes[1]), 1)
    cand = files.filter(F.col("ext") == "json").withColumn("_t", tier).filter(F.col("_t").isNotNull())
    best = cand.groupBy(by).agg(F.min("_t").alias("_bt"))
    c = cand.join(best, by).filter(F.col("_t") == F.col("_bt"))
    g = c.groupBy(by).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(name == target, F.col("path"))).alias("_ex"),
        F.min("path").alias("_mn"), F.min(F.when(name.contains(channel), F.col("path"))).alias("_ct"),
        F.max_by("path", F.struct("mtime_s", "path")).alias("_nw"))
    dirs = files.select(by).distinct()
    new_path = F.concat(F.col(by), F.lit("/" + target))
    return (dirs.join(g, by, "left")
            .select(by, F.coalesce("_ex", F.when(F.col("_n") == 1, F.col("_mn")), "_ct", "_nw", new_path).alias("path"),
                    F.col("_n").isNull().alias("is_new")))
