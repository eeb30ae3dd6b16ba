"""Registered corpus-state queries (merges, joins, sources, plan) with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import state as ST
from ..session import drop_table_path, ensure_checkpoint_dir
from ..sources import fixtures as X
from ..sources import state_files as SF
from ..sources.documents import drop_documents, write_documents
from . import oracle_sql as O
from .registry import register

AS_OF = X.OUTCOME_AS_OF
SINCE = "20240115"
PLAYLIST_CTX = "PLX"
CHANNEL_NAME = "up3"
#: Metadata files on disk at a time, about (4 KB of disk each).
INFO_FILES = 8_000_000


def _ev(spark, d):
    return X.table(spark, d, "events")


def _obs_rows(spark, d):
    return X.fx_obs_rows(_ev(spark, d))


def _history(spark, d):
    return ST.merge_videos(_obs_rows(spark, d))


def _listing(spark, d):
    return ST.listing_rows(X.fx_listing(X.table(spark, d, "orders")))


def _pl(c="playlists"):
    return F.array_join(F.col(c), ",").alias(c)


MERGE_COLS = ("video_id", "publish_date", "title", "subtitle_downloaded", "info_downloaded", "has_no_subtitle",
              "channel_id", "uploader", "uploader_id", "duration_s", "channel", "view_count", "ord")


def merge_sql(src: str) -> str:
    return f"""
SELECT video_id,
  coalesce(arg_min(publish_date, ord) FILTER (WHERE publish_date IS NOT NULL AND publish_date NOT IN ('', 'N/A')),
           arg_min_null(publish_date, ord)) AS publish_date,
  coalesce(arg_min(title, ord) FILTER (WHERE title IS NOT NULL AND title NOT IN ('', 'N/A', 'Avulso')),
           arg_min_null(title, ord)) AS title,
  coalesce(bool_or(subtitle_downloaded), false) AS subtitle_downloaded,
  coalesce(bool_or(info_downloaded), false) AS info_downloaded,
  coalesce(bool_or(has_no_subtitle), false) AS has_no_subtitle,
  arg_min_null(channel_id, ord) AS channel_id, arg_min_null(uploader, ord) AS uploader,
  arg_min_null(uploader_id, ord) AS uploader_id, arg_min_null(duration_s, ord) AS duration_s,
  arg_min_null(channel, ord) AS channel, arg_min_null(view_count, ord) AS view_count, min(ord) AS ord
FROM {src} GROUP BY video_id"""


def playlists_sql(src: str) -> str:
    """Ordered distinct union of playlists per video (NULL when no row had a list)."""
    return f"""
SELECT h.video_id, CASE WHEN h.has THEN coalesce(p.pl, '') END AS playlists
FROM (SELECT video_id, bool_or(playlists IS NOT NULL) AS has FROM {src} GROUP BY ALL) h
LEFT JOIN (SELECT video_id, string_agg(playlist, ',' ORDER BY ord, pos) AS pl FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, playlist ORDER BY ord, pos) AS rn FROM (
      SELECT video_id, ord, unnest(playlists) AS playlist, generate_subscripts(playlists, 1) AS pos FROM {src}))
  WHERE rn = 1 GROUP BY ALL) p USING (video_id)"""


O.cte("history", merge_sql("obs_rows"), ["obs_rows"])
O.cte("history_pl", playlists_sql("obs_rows"), ["obs_rows"])
O.cte("state_dedup", "SELECT h.*, p.playlists FROM history h JOIN history_pl p USING (video_id)",
      ["history", "history_pl"])


@register("merge_videos", O.sql("SELECT * FROM history", "history"))
def q_merge_videos(spark, d):
    return _history(spark, d).select(*MERGE_COLS)


@register("dedup_state", O.sql("SELECT * FROM state_dedup", "state_dedup"))
def q_dedup_state(spark, d):
    s = ST.dedup_state(_obs_rows(spark, d))
    return s.select(*MERGE_COLS, _pl())


@register("union_playlists", O.sql("SELECT * FROM history_pl", "history_pl"))
def q_union_playlists(spark, d):
    """Ordered distinct union of every observation's playlists, per video."""
    return ST.dedup_state(_obs_rows(spark, d)).select("video_id", _pl())


# ------------------------------------------------------------------ sources
O.cte("state_doc_rows", f"""
SELECT '{SF.STATE_PREFIXES[0]}' || channel_id || '-' || CAST(ord // 1000 AS VARCHAR) || '.json' AS path,
  CASE WHEN CAST(regexp_extract(channel_id, '(\\d+)$', 1) AS INTEGER) % 2 = 0 THEN channel_id END AS channel,
  CAST(row_number() OVER (PARTITION BY channel_id, ord // 1000 ORDER BY ord) - 1 AS BIGINT) AS pos, *
FROM obs_rows""", ["obs_rows"])


@register("read_channel_state", O.sql("""
SELECT path, channel, pos, video_id, publish_date, title, subtitle_downloaded, info_downloaded, has_no_subtitle,
  array_to_string(playlists, ',') AS playlists, channel_id, uploader, uploader_id, duration_s, view_count
FROM state_doc_rows""", "state_doc_rows"))
def q_read_channel_state(spark, d):
    """State documents (both shapes), written as files to the shared checkpoint folder and
    read back by ranges that cut them anywhere."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    docs = X.fx_state_docs(_ev(spark, d))
    write_documents(docs.select(F.col("path").alias("file"), F.lit(0).alias("k"), F.col("doc").alias("piece")), path, "k")
    r = SF.read_channel_state(spark, path, range_bytes=1 << 16)
    return r.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("path"), F.col("doc_channel").alias("channel"), "pos", "video_id", "publish_date", "title", "subtitle_downloaded",
                    "info_downloaded", "has_no_subtitle", _pl(), "channel_id", "uploader", "uploader_id",
                    "duration_s", "view_count")


@register("read_listing", O.sql("""
SELECT video_id, title, upload_date, epoch_s FROM listing WHERE ord % 50 <> 0 AND ord % 51 <> 0""", "listing"))
def q_read_listing(spark, d):
    """JSON listing lines (some cut, some without id), written as files to the shared
    checkpoint folder and read back by the reader."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    X.fx_listing_docs(X.table(spark, d, "orders")).select("value").write.text(path)
    return SF.read_listing(spark, path).select("video_id", "title", "upload_date", "epoch_s")


O.cte("info_rows", """
SELECT video_id, ord,
  coalesce(nullif(title, ''), nullif(fulltitle, ''), 'Avulso') AS title,
  coalesce(CASE WHEN regexp_matches(rd, '^[0-9]{8}$') THEN substr(rd, 1, 4) || '-' || substr(rd, 5, 2) || '-' || substr(rd, 7, 2)
                ELSE rd END, 'N/A') AS publish_date,
  coalesce(sd, false) AS subtitle_downloaded, rd IS NOT NULL AS info_downloaded, false AS has_no_subtitle,
  coalesce(nullif(m_channel_id, ''), m_uploader_id) AS channel_id,
  coalesce(nullif(m_uploader, ''), m_channel) AS uploader,
  coalesce(nullif(m_uploader_id, ''), m_channel_id) AS uploader_id
FROM (
  SELECT o.video_id, o.ord,
    CASE WHEN o.ord % 4 <> 0 THEN 'T' || CAST(o.ord AS VARCHAR) END AS title,
    CASE WHEN o.ord % 8 = 0 THEN 'F' || CAST(o.ord AS VARCHAR) END AS fulltitle,
    coalesce(CASE WHEN o.ord % 3 = 0 THEN strftime(e.ts, '%Y%m%d') WHEN o.ord % 3 = 2 THEN 'soon' END,
             CASE WHEN o.ord % 5 = 0 THEN strftime(e.ts, '%Y-%m-%d') END) AS rd,
    o.ord % 9 = 0 AS sd,
    CASE WHEN o.ord % 2 = 0 THEN o.channel_id END AS m_channel_id,
    CASE WHEN o.ord % 6 <> 1 THEN o.uploader_id END AS m_uploader_id,
    CASE WHEN o.ord % 3 <> 1 THEN o.uploader END AS m_uploader,
    'Channel ' || o.channel_id AS m_channel
  FROM obs o JOIN events e ON e.event_id = o.ord
  WHERE o.ord % 13 <> 0)""", ["obs"])


@register("read_video_info", O.sql("SELECT * EXCLUDE (ord) FROM info_rows", "info_rows"))
def q_read_video_info(spark, d):
    """Per-video metadata documents, written as files to the shared checkpoint folder (a
    folder for each observation of a video) and read back by the reader. A file takes a
    block of the disk, however small it is: of more documents than ``INFO_FILES`` so many
    at a time are files, and what the reader gives of them is kept as a table."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/info-{uuid.uuid4().hex}"
    events = _ev(spark, d)
    rounds = -(-events.count() // INFO_FILES)
    nth = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    docs = X.fx_info_docs(events).withColumn("nth", nth)

    def read_back(some, path):
        write_documents(some.select(F.concat(F.col("nth").cast("string"), F.lit("/"), "name").alias("file"), "nth",
                                    F.col("doc").alias("piece")), path, "nth")
        return SF.read_video_info(spark, f"{path}/*")
    if rounds <= 1:
        return read_back(docs, root)
    docs.select("name", "nth", "doc", F.pmod(F.xxhash64("name", "nth"), F.lit(rounds)).alias("round")) \
        .write.partitionBy("round").option("compression", "zstd").parquet(f"{root}/docs")
    docs = spark.read.parquet(f"{root}/docs")
    for k in range(rounds):
        some = docs.where(F.col("round") == k)
        if not some.isEmpty():
            read_back(some, f"{root}/{k}").write.mode("append").parquet(f"{root}/rows")
            drop_documents(spark, f"{root}/{k}")
    drop_table_path(spark, f"{root}/docs")
    return spark.read.parquet(f"{root}/rows")


O.cte("u", """
SELECT video_id, publish_date, title, subtitle_downloaded, info_downloaded, has_no_subtitle, channel_id, uploader,
  uploader_id, duration_s, CAST(NULL AS VARCHAR) AS channel, view_count, {'src': 0, 'p': path, 'k': pos} AS ord
FROM state_doc_rows
UNION ALL
SELECT video_id, publish_date, title, subtitle_downloaded, info_downloaded, has_no_subtitle, channel_id, uploader,
  uploader_id, NULL, NULL, NULL, {'src': 1, 'p': '', 'k': ord}
FROM info_rows""", ["state_doc_rows", "info_rows"])


@register("union_history", O.sql(f"SELECT * EXCLUDE (ord), ord['src'] AS first_src FROM ({merge_sql('u')})", "u"))
def q_union_history(spark, d):
    """State-document rows first (by path, then position), then metadata rows."""
    ev = _ev(spark, d)
    docs = SF.parse_state_documents(X.fx_state_docs(ev)).drop("doc_channel", "detected_language")
    a = docs.withColumn("ord", F.struct(F.col("path").alias("p"), F.col("pos").alias("k"))).drop("path", "pos")
    info = SF.parse_video_info(X.fx_info_docs(ev), keep=("ord",))
    b = info.withColumn("ord", F.struct(F.lit("").alias("p"), F.col("ord").alias("k")))
    m = ST.union_history(a, b)
    return m.select(*[c for c in MERGE_COLS if c != "ord"], F.col("ord.src").alias("first_src"))


# ------------------------------------------------------------------ listing, upsert, reverse import
@register("normalize_date", O.sql("SELECT video_id, ord, publish_date FROM listing_rows", "listing_rows"))
def q_normalize_date(spark, d):
    return _listing(spark, d).select("video_id", "ord", "publish_date")


@register("coalesce_title", O.sql("SELECT video_id, ord, title FROM listing_rows", "listing_rows"))
def q_coalesce_title(spark, d):
    return _listing(spark, d).select("video_id", "ord", "title")


O.cte("listing_filled", """
SELECT l.video_id, l.ord,
  CASE WHEN l.publish_date = 'N/A' AND h.publish_date IS NOT NULL AND h.publish_date NOT IN ('', 'N/A')
       THEN h.publish_date ELSE l.publish_date END AS publish_date,
  l.title, l.subtitle_downloaded, l.info_downloaded, l.has_no_subtitle
FROM listing_rows l LEFT JOIN history h USING (video_id)""", ["listing_rows", "history"])


@register("fill_dates", O.sql("SELECT video_id, ord, publish_date, title FROM listing_filled", "listing_filled"))
def q_fill_dates(spark, d):
    """The history as observed: ids repeat, the first valid date counts."""
    return ST.fill_dates(_listing(spark, d), _obs_rows(spark, d)).select("video_id", "ord", "publish_date", "title")


O.cte("upsert_u", """
SELECT video_id, publish_date, title, subtitle_downloaded, info_downloaded, has_no_subtitle, channel_id, uploader,
  uploader_id, duration_s, channel, view_count, ord AS ord, 0 AS src,
  CASE WHEN playlists IS NULL THEN NULL ELSE string_split(playlists, ',') END AS playlists
FROM state_dedup
UNION ALL
SELECT video_id, publish_date, title, subtitle_downloaded, info_downloaded, has_no_subtitle, NULL, NULL, NULL, NULL,
  NULL, NULL, 1000000000000 + ord, 1, ['PLX']
FROM listing_filled""", ["state_dedup", "listing_filled"])
O.cte("upserted", f"""
SELECT m.* EXCLUDE (ord), p.playlists, CASE WHEN s.s = 0 THEN 'state' ELSE 'listed' END AS src
FROM ({merge_sql('upsert_u')}) m JOIN ({playlists_sql('upsert_u')}) p USING (video_id)
JOIN (SELECT video_id, min(src) AS s FROM upsert_u GROUP BY ALL) s USING (video_id)""", ["upsert_u"])


def _upserted(spark, d):
    state = ST.dedup_state(_obs_rows(spark, d))
    listing = ST.fill_dates(_listing(spark, d), _history(spark, d))
    return ST.upsert_listing(state, listing, PLAYLIST_CTX)


@register("upsert_listing", O.sql("SELECT * FROM upserted", "upserted"))
def q_upsert_listing(spark, d):
    u = _upserted(spark, d)
    return u.select(*[c for c in MERGE_COLS if c != "ord"], _pl(), "src")


@register("upsert_listing_buckets", O.sql("SELECT * EXCLUDE (src) FROM upserted", "upserted"))
def q_upsert_listing_buckets(spark, d):
    """The same upsert into a state kept in buckets: only those that the listing hits are
    read and rewritten; the whole table is read back."""
    from .state_buckets import read_buckets, upsert_buckets, write_buckets
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/buckets-{uuid.uuid4().hex}"
    write_buckets(ST.dedup_state(_obs_rows(spark, d)), path, buckets=32)
    upsert_buckets(spark, path, ST.fill_dates(_listing(spark, d), _history(spark, d)), PLAYLIST_CTX, buckets=32)
    return read_buckets(spark, path).select(*[c for c in MERGE_COLS if c != "ord"], _pl())


O.cte("target", """
SELECT h.video_id, h.channel_id, h.uploader_id
FROM (SELECT arg_min(video_id, ord) AS video_id FROM listing_c) f JOIN history h USING (video_id)""",
      ["listing_c", "history"])
O.cte("listing_c", """
SELECT 'e' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS video_id, o_orderkey AS ord, o_orderpriority AS title,
  substr(strftime(o_orderdate, '%Y%m%d'), 1, 4) || '-' || substr(strftime(o_orderdate, '%Y%m%d'), 5, 2) || '-'
  || substr(strftime(o_orderdate, '%Y%m%d'), 7, 2) AS publish_date,
  false AS subtitle_downloaded, false AS info_downloaded, false AS has_no_subtitle
FROM orders""")


def _listing_c(spark, d):
    return X.fx_listing_by_customer(X.table(spark, d, "orders"))


@register("target_channel", O.sql("SELECT * FROM target", "target"))
def q_target_channel(spark, d):
    return ST.target_channel(_listing_c(spark, d), _history(spark, d))


O.cte("listing_state", merge_sql("listing_c").replace("arg_min_null(channel, ord)", "NULL")
      .replace("arg_min_null(channel_id, ord)", "NULL").replace("arg_min_null(uploader, ord)", "NULL")
      .replace("arg_min_null(uploader_id, ord)", "NULL").replace("arg_min_null(duration_s, ord)", "NULL")
      .replace("arg_min_null(view_count, ord)", "NULL"), ["listing_c"])
O.cte("imported", f"""
SELECT h.video_id, h.channel_id, h.uploader_id, h.uploader FROM history h LEFT JOIN target t ON true  -- without a target the name alone decides
WHERE h.video_id NOT IN (SELECT video_id FROM listing_state)
  AND ((t.channel_id IS NOT NULL AND t.channel_id <> '' AND h.channel_id = t.channel_id)
    OR (t.uploader_id IS NOT NULL AND t.uploader_id <> '' AND h.uploader_id = t.uploader_id)
    OR contains(lower(coalesce(h.uploader, '')), '{CHANNEL_NAME}'))""", ["history", "target", "listing_state"])


def _listing_state(spark, d):
    """The current state of a second channel: its listing, merged by id."""
    return ST.merge_videos(ST.listing_rows(_listing_c(spark, d)))


@register("reverse_import", O.sql("SELECT * FROM imported", "imported"))
def q_reverse_import(spark, d):
    """History rows of the target channel that the current listing lacks."""
    hist = _history(spark, d)
    tgt = ST.target_channel(_listing_c(spark, d), hist)
    imp = ST.reverse_import(_listing_state(spark, d), hist, tgt, CHANNEL_NAME)
    return imp.select("video_id", "channel_id", "uploader_id", "uploader")


# ------------------------------------------------------------------ legacy logs
O.cte("log_ids", """
SELECT DISTINCT 'subtitle' AS kind, video_id FROM obs WHERE subtitle_downloaded
UNION SELECT DISTINCT 'info', video_id FROM obs WHERE info_downloaded
UNION SELECT DISTINCT 'no_subtitle', video_id FROM obs WHERE has_no_subtitle""", ["obs"])


@register("read_legacy_logs", O.sql("SELECT * FROM log_ids", "log_ids"))
def q_read_legacy_logs(spark, d):
    """Legacy logs (with noise), written under their names to the shared checkpoint
    folder and read back by the reader."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logs-{uuid.uuid4().hex}"
    lines = X.fx_log_lines(_ev(spark, d))
    for name in X.LOG_FILES:
        lines.filter(F.col("file") == name).select("value").write.text(f"{root}/{name}")
    return SF.read_legacy_logs(spark, f"{root}/*")


@register("apply_legacy_flags", O.sql("""
SELECT s.video_id,
  s.subtitle_downloaded OR coalesce(g.s, false) AS subtitle_downloaded,
  s.info_downloaded OR coalesce(g.i, false) AS info_downloaded,
  s.has_no_subtitle OR coalesce(g.n, false) AS has_no_subtitle,
  CAST(coalesce(g.s AND NOT s.subtitle_downloaded, false) AS INTEGER)
  + CAST(coalesce(g.i AND NOT s.info_downloaded, false) AS INTEGER)
  + CAST(coalesce(g.n AND NOT s.has_no_subtitle, false) AS INTEGER) AS flips
FROM listing_state s LEFT JOIN (
  SELECT video_id, bool_or(kind = 'subtitle') AS s, bool_or(kind = 'info') AS i, bool_or(kind = 'no_subtitle') AS n
  FROM log_ids GROUP BY ALL) g USING (video_id)""", "listing_state", "log_ids"))
def q_apply_legacy_flags(spark, d):
    logs = SF.parse_log_lines(X.fx_log_lines(_ev(spark, d)))
    out = ST.apply_legacy_flags(_listing_state(spark, d), logs)
    return out.select("video_id", "subtitle_downloaded", "info_downloaded", "has_no_subtitle", "flips")


# ------------------------------------------------------------------ metadata harvest / heal / focus
O.cte("listing_first", """
SELECT video_id, arg_min_null(title, ord) AS title, arg_min_null(upload_date, ord) AS upload_date,
  arg_min_null(epoch_s, ord) AS epoch_s, min(ord) AS ord FROM listing GROUP BY ALL""", ["listing"])


def _info(spark, d):
    """Metadata rows from the listing; ids repeat, the first row counts."""
    return X.fx_listing(X.table(spark, d, "orders")).select(
        "video_id", "ord", "title", "upload_date", F.col("ord").cast("double").alias("duration"),
        F.concat(F.lit("Ch "), F.col("title")).alias("channel"), F.lit(None).cast("string").alias("uploader"),
        F.col("epoch_s").alias("view_count"))


def _recovered(spark, d):
    """A second source; ids repeat, the first row counts."""
    return _listing(spark, d).select("video_id", "ord", F.col("publish_date").alias("date"), "title")


@register("harvest_metadata", O.sql("""
SELECT h.video_id,
  CASE WHEN i.video_id IS NOT NULL AND (h.title IS NULL OR h.title IN ('', 'N/A', 'Avulso'))
       THEN coalesce(nullif(i.title, ''), h.title) ELSE h.title END AS title,
  CASE WHEN i.video_id IS NOT NULL AND (h.publish_date IS NULL OR h.publish_date IN ('', 'N/A'))
            AND length(i.upload_date) = 8
       THEN substr(i.upload_date, 1, 4) || '-' || substr(i.upload_date, 5, 2) || '-' || substr(i.upload_date, 7, 2)
       ELSE h.publish_date END AS publish_date,
  CASE WHEN i.video_id IS NOT NULL AND (h.duration_s IS NULL OR h.duration_s = 0) THEN CAST(i.ord AS DOUBLE)
       ELSE h.duration_s END AS duration_s,
  CASE WHEN i.video_id IS NOT NULL AND (h.channel IS NULL OR h.channel = '') THEN 'Ch ' || i.title ELSE h.channel END
    AS channel,
  CASE WHEN i.video_id IS NOT NULL AND (h.view_count IS NULL OR h.view_count = 0) THEN i.epoch_s
       ELSE h.view_count END AS view_count,
  h.info_downloaded OR i.video_id IS NOT NULL AS info_downloaded
FROM history h LEFT JOIN listing_first i USING (video_id)""", "history", "listing_first"))
def q_harvest_metadata(spark, d):
    out = ST.harvest_metadata(_history(spark, d), _info(spark, d))
    return out.select("video_id", "title", "publish_date", "duration_s", "channel", "view_count", "info_downloaded")


@register("heal_metadata", O.sql("""
SELECT h.video_id,
  CASE WHEN coalesce(h.title, 'N/A') = 'N/A' AND r.title IS NOT NULL AND r.title <> 'N/A' THEN r.title ELSE h.title END
    AS title,
  CASE WHEN coalesce(h.publish_date, 'N/A') = 'N/A' AND r.date IS NOT NULL AND r.date <> 'N/A' THEN r.date
       ELSE h.publish_date END AS publish_date,
  coalesce((coalesce(h.title, 'N/A') = 'N/A' AND r.title IS NOT NULL AND r.title <> 'N/A')
        OR (coalesce(h.publish_date, 'N/A') = 'N/A' AND r.date IS NOT NULL AND r.date <> 'N/A'), false) AS healed
FROM history h LEFT JOIN (SELECT video_id, arg_min_null(publish_date, ord) AS date, arg_min_null(title, ord) AS title
                          FROM listing_rows GROUP BY ALL) r USING (video_id)""", "history", "listing_rows"))
def q_heal_metadata(spark, d):
    out = ST.heal_metadata(_history(spark, d), _recovered(spark, d))
    return out.select("video_id", "title", "publish_date", F.coalesce("healed", F.lit(False)).alias("healed"))


@register("focus_video", O.sql("""
SELECT i.video_id, CASE WHEN h.video_id IS NULL THEN 'N/A' ELSE h.publish_date END AS publish_date,
  CASE WHEN h.video_id IS NULL THEN 'Avulso' ELSE h.title END AS title,
  coalesce(h.subtitle_downloaded, false) AS subtitle_downloaded, coalesce(h.info_downloaded, false) AS info_downloaded,
  coalesce(h.has_no_subtitle, false) AS has_no_subtitle, h.video_id IS NULL AS injected
FROM (SELECT DISTINCT video_id FROM listing) i LEFT JOIN history h USING (video_id)""", "listing", "history"))
def q_focus_video(spark, d):
    """Requested ids = every listed id; ids the state lacks get a default row."""
    ids = X.fx_listing(X.table(spark, d, "orders")).select("video_id")
    return ST.focus_video(_history(spark, d), ids)


@register("filter_since", O.sql(f"""
SELECT video_id, publish_date, title FROM history
WHERE publish_date IS NOT NULL AND publish_date NOT IN ('', 'N/A') AND replace(publish_date, '-', '') >= '{SINCE}'""",
                                 "history"))
def q_filter_since(spark, d):
    return ST.filter_since(_history(spark, d), SINCE).select("video_id", "publish_date", "title")


@register("maturity_gate", O.sql(f"""
SELECT video_id, publish_date,
  coalesce(date_diff('day', try_strptime(publish_date, '%Y-%m-%d')::DATE, DATE '{AS_OF}') > 7, true) AS mature
FROM history""", "history"))
def q_maturity_gate(spark, d):
    h = _history(spark, d)
    return h.select("video_id", "publish_date", S.maturity_gate("publish_date", F.to_date(F.lit(AS_OF))).alias("mature"))


@register("date_coverage", O.sql("""
SELECT count(*) FILTER (WHERE publish_date IS NOT NULL AND publish_date NOT IN ('', 'N/A')) AS with_date,
  count(*) AS total FROM listing_filled""", "listing_filled"))
def q_date_coverage(spark, d):
    return ST.date_coverage(ST.fill_dates(_listing(spark, d), _history(spark, d)))


@register("state_summary", O.sql("""
SELECT channel_id, count(*) FILTER (WHERE info_downloaded) AS info_downloaded,
  count(*) FILTER (WHERE has_no_subtitle) AS has_no_subtitle, count(*) AS total FROM history GROUP BY ALL""",
                                 "history"))
def q_state_summary(spark, d):
    return ST.state_summary(_history(spark, d))


O.cte("synced", """
SELECT video_id, '' AS channel_id, CASE WHEN min(src) = 0 THEN 'state' ELSE 'listed' END AS src,
  false AS sd, false AS id, false AS nd
FROM (SELECT video_id, 0 AS src FROM listing_state UNION ALL SELECT video_id, 1 FROM listing_filled) GROUP BY video_id
UNION ALL
SELECT video_id, coalesce(i.channel_id, ''), 'imported', h.subtitle_downloaded, h.info_downloaded, h.has_no_subtitle
FROM imported i JOIN history h USING (video_id)""", ["listing_state", "listing_filled", "imported", "history"])


@register("sync_counts", O.sql("""
SELECT channel_id, count(*) FILTER (WHERE src = 'state') AS from_state,
  count(*) FILTER (WHERE src = 'listed') AS newly_listed, count(*) FILTER (WHERE src = 'imported') AS imported,
  CAST(sum(CAST(coalesce(g.s AND NOT sd, false) AS INTEGER) + CAST(coalesce(g.i AND NOT id, false) AS INTEGER)
           + CAST(coalesce(g.n AND NOT nd, false) AS INTEGER)) AS BIGINT) AS legacy_flips
FROM synced LEFT JOIN (
  SELECT video_id, bool_or(kind = 'subtitle') AS s, bool_or(kind = 'info') AS i, bool_or(kind = 'no_subtitle') AS n
  FROM log_ids GROUP BY ALL) g USING (video_id)
GROUP BY channel_id""", "synced", "log_ids"))
def q_sync_counts(spark, d):
    """Per channel: rows kept from the state, newly listed and imported from history,
    and flags that the legacy logs flipped. The state is that of the second channel."""
    hist = _history(spark, d)
    state = _listing_state(spark, d)
    merged = ST.upsert_listing(state, ST.fill_dates(_listing(spark, d), hist), PLAYLIST_CTX)
    tgt = ST.target_channel(_listing_c(spark, d), hist)
    imp = ST.reverse_import(state, hist, tgt, CHANNEL_NAME).withColumn("src", F.lit("imported"))
    cols = ["video_id", "channel_id", "src", *ST.FLAGS]
    logs = SF.parse_log_lines(X.fx_log_lines(_ev(spark, d)))
    return ST.sync_counts(ST.apply_legacy_flags(merged.select(*cols).unionByName(imp.select(*cols)), logs))


# ------------------------------------------------------------------ playlists, languages
@register("playlist_owner", O.sql("""
SELECT playlist, regexp_replace(arg_min(uploader_id, ord), '^@+', '') AS owner FROM (
  SELECT ord, uploader_id, unnest(playlists) AS playlist FROM obs_rows
  WHERE uploader_id IS NOT NULL AND uploader_id <> '') GROUP BY ALL""", "obs_rows"))
def q_playlist_owner(spark, d):
    return ST.playlist_owner(_obs_rows(spark, d))


O.cte("lang_votes", """
SELECT channel, tag, count(*) AS votes, min(rk) AS first FROM (
  SELECT * FROM (SELECT channel, lower(trim(tag)) AS tag, row_number() OVER (PARTITION BY channel ORDER BY ord) AS rk
                 FROM tags WHERE lower(trim(tag)) <> '') WHERE rk <= 5)
WHERE tag NOT IN ('na', 'n/a', 'none', 'null', 'undefined') GROUP BY ALL""", ["tags"])
O.cte("detected", """
SELECT c.channel, coalesce(split_part(split_part(b.tag, '-', 1), '_', 1), 'pt') AS lang,
  coalesce(b.votes, 0) AS votes, coalesce(n.n, 0) AS n
FROM (SELECT DISTINCT channel FROM tags) c
LEFT JOIN (SELECT channel, arg_min(tag, (-votes, first)) AS tag, arg_min(votes, (-votes, first)) AS votes
           FROM lang_votes GROUP BY ALL) b USING (channel)
LEFT JOIN (SELECT channel, CAST(sum(votes) AS BIGINT) AS n FROM lang_votes GROUP BY ALL) n USING (channel)""",
      ["lang_votes"])


@register("detect_language", O.sql("SELECT * FROM detected", "detected"))
def q_detect_language(spark, d):
    return ST.detect_language(X.fx_tags(X.table(spark, d, "documents")))


@register("resolve_language", O.sql("""
SELECT c.channel, coalesce(CASE WHEN c.stored_lang <> 'N/A' THEN trim(c.stored_lang, '^$') END, d.lang, 'pt') AS lang
FROM (SELECT DISTINCT source AS channel,
        CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN '^en$' END
          AS stored_lang FROM documents) c
LEFT JOIN detected d USING (channel)""", "detected"))
def q_resolve_language(spark, d):
    docs = X.table(spark, d, "documents")
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 3
    chans = docs.select(F.col("source").alias("channel"),
                        F.when(n == 0, "N/A").when(n == 1, "^en$").alias("stored_lang")).distinct()
    return ST.resolve_language(chans, ST.detect_language(X.fx_tags(docs)))


@register("clean_lang_tag", O.sql("""
SELECT channel, ord, CASE WHEN lower(trim(tag)) IN ('na', 'n/a', 'none', 'null', 'undefined', '') THEN NULL
  ELSE split_part(split_part(lower(trim(tag)), '-', 1), '_', 1) END AS lang FROM tags""", "tags"))
def q_clean_lang_tag(spark, d):
    t = X.fx_tags(X.table(spark, d, "documents"))
    return t.select("channel", "ord", S.clean_lang_tag("tag").alias("lang"))


# ------------------------------------------------------------------ user input
@register("classify_input", O.sql("""
SELECT page_id, input,
  CASE WHEN contains(input, 'watch?v=') OR contains(input, 'youtu.be/')
         THEN CASE WHEN starts_with(input, 'http') THEN input ELSE 'https://www.youtube.com/watch?v=' || input END
       WHEN regexp_full_match(input, '[A-Za-z0-9_-]{11}') THEN 'https://www.youtube.com/watch?v=' || input
       ELSE CASE WHEN starts_with(input, 'http') THEN input ELSE 'https://www.youtube.com/' || input END END AS url,
  CASE WHEN contains(input, 'watch?v=') OR contains(input, 'youtu.be/') OR regexp_full_match(input, '[A-Za-z0-9_-]{11}')
         THEN 'video' WHEN contains(input, 'playlist?list=') THEN 'playlist' ELSE 'channel' END AS kind,
  CASE WHEN contains(input, 'watch?v=') OR contains(input, 'youtu.be/')
         THEN regexp_extract(CASE WHEN starts_with(input, 'http') THEN input
                                  ELSE 'https://www.youtube.com/watch?v=' || input END,
                             '(?:v=|youtu\\.be/)([A-Za-z0-9_-]{11})', 1)
       WHEN regexp_full_match(input, '[A-Za-z0-9_-]{11}') THEN input ELSE '' END AS video_id
FROM inputs""", "inputs"))
def q_classify_input(spark, d):
    i = X.fx_inputs(X.table(spark, d, "pages"))
    c = S.classify_input("input")
    return i.select("page_id", "input", c["url"].alias("url"), c["kind"].alias("kind"), c["video_id"].alias("video_id"))


@register("channel_key", O.sql("""
SELECT page_id, input,
  CASE WHEN contains(input, 'watch?v=') OR contains(input, 'youtu.be/')
         THEN 'video_' || coalesce(nullif(regexp_extract(input, '(?:v=|youtu\\.be/)([A-Za-z0-9_-]{11})', 1), ''), 'video')
       WHEN contains(input, '@') THEN coalesce(nullif(regexp_extract(input, '@([A-Za-z0-9_-]+)', 1), ''), 'canal')
       WHEN contains(input, 'list=')
         THEN 'playlist_' || coalesce(nullif(regexp_extract(input, 'list=([A-Za-z0-9_-]+)', 1), ''), 'playlist')
       ELSE 'canal' END AS channel_key
FROM inputs""", "inputs"))
def q_channel_key(spark, d):
    i = X.fx_inputs(X.table(spark, d, "pages"))
    return i.select("page_id", "input", S.channel_key("input").alias("channel_key"))


@register("listing_url", O.sql("""
SELECT page_id, url,
  CASE WHEN contains(url, 'watch?v=') OR contains(url, 'playlist?list=') OR ends_with(url, '/videos')
         OR ends_with(url, '/shorts') OR ends_with(url, '/streams') OR ends_with(url, '/live') THEN url
       ELSE regexp_replace(url, '/+$', '') || '/videos' END AS listing_url
FROM (SELECT page_id, CASE WHEN starts_with(input, 'http') THEN input ELSE 'https://www.youtube.com/' || input END
        AS url FROM inputs)""", "inputs"))
def q_listing_url(spark, d):
    i = X.fx_inputs(X.table(spark, d, "pages"))
    u = F.when(F.col("input").startswith("http"), F.col("input")).otherwise(
        F.concat(F.lit(S.SITE_ROOT), F.col("input")))
    return i.select("page_id", u.alias("url")).select("page_id", "url", S.listing_url("url").alias("listing_url"))
