"""Registered whole flows (channel sync, offline regeneration) and the other modes of
operators whose default mode has a query of its own, with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import state as ST
from ..sources import fixtures as X
from ..sources import state_files as SF
from . import oracle_sql as O
from . import registry_files  # noqa: F401  (its oracle tables are used below)
from . import registry_state as RS
from .registry import register
from .sync import channel_sync, regen_documents, sync_folder

# ------------------------------------------------------------------ channel sync
O.cte("cs_obs", "SELECT * FROM obs_rows WHERE subtitle_downloaded", ["obs_rows"])
O.cte("cs_stored", f"""
SELECT m.*, string_split(p.playlists, ',') AS playlists
FROM ({RS.merge_sql('cs_obs')}) m JOIN ({RS.playlists_sql('cs_obs')}) p USING (video_id)""", ["cs_obs"])
O.cte("cs_u", """
SELECT video_id, publish_date, title, subtitle_downloaded, info_downloaded, has_no_subtitle, channel_id, uploader,
  uploader_id, duration_s, channel, view_count, {'src': 0, 'k': ord} AS ord, playlists
FROM cs_stored
UNION ALL
SELECT video_id, publish_date, title, subtitle_downloaded, info_downloaded, has_no_subtitle, NULL, NULL, NULL, NULL,
  NULL, NULL, {'src': 1, 'k': ord}, ['PLX']
FROM listing_c""", ["cs_stored", "listing_c"])
O.cte("cs_merged", f"""
SELECT m.* EXCLUDE (ord), p.playlists
FROM ({RS.merge_sql('cs_u')}) m JOIN ({RS.playlists_sql('cs_u')}) p USING (video_id)""", ["cs_u"])
O.cte("cs_target", """
SELECT h.channel_id, h.uploader_id FROM (SELECT arg_min(video_id, ord) AS video_id FROM listing_c) f
JOIN history h USING (video_id)""", ["listing_c", "history"])
O.cte("cs_full", f"""
SELECT video_id, publish_date, title, subtitle_downloaded, info_downloaded, has_no_subtitle, channel_id, duration_s,
  channel, view_count, playlists FROM cs_merged
UNION ALL
SELECT h.video_id, h.publish_date, h.title, h.subtitle_downloaded, h.info_downloaded, h.has_no_subtitle, h.channel_id,
  h.duration_s, h.channel, h.view_count, array_to_string(p.playlists, ',')
FROM history h JOIN (SELECT video_id, arg_min(playlists, ord) AS playlists FROM obs_rows GROUP BY ALL) p USING (video_id)
WHERE h.video_id NOT IN (SELECT video_id FROM cs_merged)
  AND (coalesce(h.channel_id IN (SELECT channel_id FROM cs_target WHERE channel_id <> ''), false)
    OR coalesce(h.uploader_id IN (SELECT uploader_id FROM cs_target WHERE uploader_id <> ''), false)
    OR contains(lower(coalesce(h.uploader, '')), '{RS.CHANNEL_NAME}'))""",
      ["cs_merged", "cs_target", "history", "obs_rows"])
# logs, then the metadata of the first listing row, then the second source
O.cte("cs_flagged", """
SELECT f.* REPLACE (subtitle_downloaded OR coalesce(g.s, false) AS subtitle_downloaded,
  info_downloaded OR coalesce(g.i, false) AS info_downloaded, has_no_subtitle OR coalesce(g.n, false) AS has_no_subtitle)
FROM cs_full f LEFT JOIN (
  SELECT video_id, bool_or(kind = 'subtitle') AS s, bool_or(kind = 'info') AS i, bool_or(kind = 'no_subtitle') AS n
  FROM log_ids GROUP BY ALL) g USING (video_id)""", ["cs_full", "log_ids"])
O.cte("cs_harvested", """
SELECT f.video_id, f.channel_id, f.subtitle_downloaded, f.has_no_subtitle, f.playlists,
  f.info_downloaded OR i.video_id IS NOT NULL AS info_downloaded,
  CASE WHEN i.video_id IS NOT NULL AND (f.title IS NULL OR f.title IN ('', 'N/A', 'Avulso'))
       THEN coalesce(nullif(i.title, ''), f.title) ELSE f.title END AS title,
  CASE WHEN i.video_id IS NOT NULL AND (f.publish_date IS NULL OR f.publish_date IN ('', 'N/A'))
            AND length(i.upload_date) = 8
       THEN substr(i.upload_date, 1, 4) || '-' || substr(i.upload_date, 5, 2) || '-' || substr(i.upload_date, 7, 2)
       ELSE f.publish_date END AS publish_date,
  CASE WHEN i.video_id IS NOT NULL AND (f.duration_s IS NULL OR f.duration_s = 0) THEN CAST(i.ord AS DOUBLE)
       ELSE f.duration_s END AS duration_s,
  CASE WHEN i.video_id IS NOT NULL AND (f.channel IS NULL OR f.channel = '') THEN 'Ch ' || i.title
       ELSE f.channel END AS channel,
  CASE WHEN i.video_id IS NOT NULL AND (f.view_count IS NULL OR f.view_count = 0) THEN i.epoch_s
       ELSE f.view_count END AS view_count
FROM cs_flagged f LEFT JOIN listing_first i USING (video_id)""", ["cs_flagged", "listing_first"])
O.cte("cs_state", """
SELECT h.* REPLACE (h.info_downloaded OR t_fix OR d_fix AS info_downloaded,
  CASE WHEN t_fix THEN rt ELSE h.title END AS title, CASE WHEN d_fix THEN rd ELSE h.publish_date END AS publish_date)
FROM (SELECT h.*, r.title AS rt, r.date AS rd,
        coalesce(h.title, 'N/A') = 'N/A' AND r.title IS NOT NULL AND r.title <> 'N/A' AS t_fix,
        coalesce(h.publish_date, 'N/A') = 'N/A' AND r.date IS NOT NULL AND r.date <> 'N/A' AS d_fix
      FROM cs_harvested h LEFT JOIN (
        SELECT video_id, arg_min_null(publish_date, ord) AS date, arg_min_null(title, ord) AS title
        FROM listing_rows GROUP BY ALL) r USING (video_id)) h""", ["cs_harvested", "listing_rows"])
O.cte("cs_plan", """
SELECT s.*, CASE WHEN s.subtitle_downloaded THEN 'skip_done' WHEN s.has_no_subtitle THEN 'skip_no_subtitle'
       WHEN coalesce(p.srt, false) AND NOT coalesce(p.md, false) THEN 'convert'
       WHEN coalesce(p.srt, false) OR coalesce(p.md, false) THEN 'skip_on_disk' ELSE 'fetch' END AS action
FROM cs_state s LEFT JOIN (
  SELECT 'e' || lpad(CAST(o_orderkey // 4 AS VARCHAR), 10, '0') AS video_id, bool_or(o_orderkey % 12 = 0) AS srt,
    bool_or(o_orderkey % 20 = 0) AS md
  FROM orders WHERE o_orderkey % 12 = 0 OR o_orderkey % 20 = 0 GROUP BY ALL) p USING (video_id)""", ["cs_state"])


O.cte("cs_synced", f"""
SELECT p.video_id, p.channel_id, p.title, p.publish_date, p.duration_s, p.channel, p.view_count, p.playlists, p.action,
  CASE WHEN p.action <> 'fetch' THEN 'skipped' WHEN o.exit_code IS NULL THEN 'pending'
       WHEN o.exit_code = 0 AND o.has_caption THEN 'downloaded' WHEN o.exit_code = 0 THEN 'skipped'
       ELSE 'error' END AS outcome,
  p.info_downloaded OR p.action IN ('convert', 'skip_on_disk') AS info_downloaded,
  p.subtitle_downloaded OR p.action IN ('convert', 'skip_on_disk')
    OR coalesce(p.action = 'fetch' AND o.exit_code = 0 AND o.has_caption, false) AS subtitle_downloaded,
  p.has_no_subtitle OR coalesce(p.action = 'fetch' AND o.exit_code = 0 AND NOT o.has_caption
    AND coalesce(date_diff('day', try_strptime(p.publish_date, '%Y-%m-%d')::DATE, DATE '{RS.AS_OF}') > 7, true), false)
    AS has_no_subtitle
FROM cs_plan p LEFT JOIN outcomes o USING (video_id)""", ["cs_plan", "outcomes"])


def _sync_inputs(spark, d):
    events, orders = X.table(spark, d, "events"), X.table(spark, d, "orders")
    return (RS._history(spark, d), X.fx_listing_by_customer(orders), SF.describe_files(X.fx_listing_files(orders)),
            {"outcomes": X.fx_outcomes(X.fx_obs(events)), "legacy_logs": SF.parse_log_lines(X.fx_log_lines(events)),
             "channel_name": RS.CHANNEL_NAME, "playlist": RS.PLAYLIST_CTX, "as_of": RS.AS_OF, "info": RS._info(spark, d),
             "recovered": RS._recovered(spark, d)})


def _stored(spark, d):
    return ST.dedup_state(X.fx_obs_rows(X.table(spark, d, "events")).filter("subtitle_downloaded"))


@register("channel_sync", O.sql("SELECT * FROM cs_synced", "cs_synced"))
def q_channel_sync(spark, d):
    """One whole channel sync: listing into the stored state (the videos that have
    captions), import from history, legacy logs, metadata, second source, plan against
    the files on disk, outcomes."""
    history, listing, files, options = _sync_inputs(spark, d)
    r = channel_sync(history, _stored(spark, d), listing, files, **options)
    return r.outcomes.select("video_id", "channel_id", "title", "publish_date", "duration_s", "channel", "view_count",
                             F.array_join("playlists", ",").alias("playlists"), "action", "outcome", *ST.FLAGS)


@register("channel_sync_saved", O.sql("""
SELECT video_id, title, publish_date, duration_s, channel, view_count, playlists, info_downloaded, subtitle_downloaded,
  has_no_subtitle, '@main' AS doc_channel, 'es' AS detected_language FROM cs_synced""", "cs_synced"))
def q_channel_sync_saved(spark, d):
    """The same sync from and to the channel's state document in a folder: written by the
    first sync under its legacy name, run, written again and read back."""
    from ..session import ensure_checkpoint_dir
    from ..sources.documents import write_documents
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sync-{uuid.uuid4().hex}"
    stored = _stored(spark, d)
    video = F.to_json(F.struct(*[c for c in stored.columns if c != "ord"]))
    ends = spark.range(2).select(F.lit(0).cast("long").alias("ord"), (F.col("id") * 2).cast("int").alias("part"),
                                 F.when(F.col("id") == 0, '{"detected_language": "es", "videos": [').otherwise("]}").alias("piece"))
    rows = stored.select("ord", F.lit(1).alias("part"), video.alias("piece")).unionByName(ends)
    write_documents(rows.withColumn("file", F.lit(f"{SF.STATE_PREFIXES[1]}main.json")), folder, "ord", separator=",")
    history, listing, files, options = _sync_inputs(spark, d)
    sync_folder(spark, folder, "main", history, listing, files, **options)
    return SF.read_channel_state(spark, folder).select(
        "video_id", "title", "publish_date", "duration_s", "channel", "view_count", F.array_join("playlists", ",").alias("playlists"),
        *ST.FLAGS, "doc_channel", "detected_language")


# ------------------------------------------------------------------ offline regeneration
def _regen_oracle() -> str:
    """The caption oracle with files in place of videos: cues, titles and addresses."""
    text = O.sql("SELECT * FROM markdown", "regen_desc", "stored_titles", "markdown")
    cues = O.CTE["cues"].replace("cues AS (", "_video_cues AS (", 1) + r""",
rg_files AS (
  SELECT * FROM regen_desc WHERE ext = 'srt' AND dir IN ('archive', '') AND mtime_s % 5 <> 0
),
cues AS (
  SELECT f.path AS video_id, f.lang, c.seq, c.start_ms, c.end_ms, c.raw_text
  FROM _video_cues c JOIN rg_files f ON f.video_id = c.video_id
)"""
    videos = r"""videos AS (
  SELECT f.path AS video_id, f.video_id AS url_id, 'Desconhecida' AS publish_date,
    coalesce(t.title, regexp_replace(f.name, '\.[^.]*$', '')) AS title
  FROM rg_files f LEFT JOIN stored_titles t ON t.video_id = f.video_id
)"""
    for old, new in ((O.CTE["cues"], cues), (O.CTE["videos"], videos), ("|| video_id || '  '", "|| v.url_id || '  '")):
        if text.count(old) != 1:
            raise ValueError("the caption oracle has changed")
        text = text.replace(old, new)
    return text


@register("regen_markdown", _regen_oracle())
def q_regen_markdown(spark, d):
    """Markdown of every caption file that has none, keyed by path: the inventory and
    texts of a working folder, titles from the stored state."""
    from ..sources.srt import render_srt
    docs = X.table(spark, d, "documents")
    folder = X.fx_regen_folder(docs)
    texts = folder.filter(F.col("path").endswith(".srt")).select("video_id", "uri") \
        .join(render_srt(X.fx_cues(docs)), "video_id").select("uri", "srt")
    return regen_documents(SF.describe_files(folder), texts, X.fx_title_state(docs))


# ------------------------------------------------------------------ other modes
def _component(text: str) -> str:
    """The oracle with a clock that shows the seconds of a minute only."""
    for clock in ("(end_ms - start_ms) // 1000", "(end_ms - clk) // 1000", "(end_ms - ns) // 1000"):
        text = text.replace(f"{clock} >", f"{clock} % 60 >")
    return text


def _component_tables(spark, d):
    from .captions import CaptionTables
    return CaptionTables(X.fx_cues(X.table(spark, d, "documents")), elapsed="component")


@register("adaptive_windows_component", _component(O.sql(
    "SELECT video_id, seq, start_ms, end_ms, win FROM cue_windows", "cue_windows")))
def q_adaptive_windows_component(spark, d):
    """Windows by the 0-59 second clock."""
    return _component_tables(spark, d).cue_windows.select("video_id", "seq", "start_ms", "end_ms", "win")


@register("paragraphs_component", _component(O.sql("SELECT * FROM paragraphs", "paragraphs")))
def q_paragraphs_component(spark, d):
    """Paragraphs by the 0-59 second clock."""
    return _component_tables(spark, d).paragraphs()


TERMS = {"the ": "THE ", "THE a": "<a", "..": "."}


@register("replace_terms", """
SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM (
  SELECT doc_id, replace(replace(replace(text, 'the ', 'THE '), 'THE a', '<a'), '..', '.') AS t FROM documents)""")
def q_replace_terms(spark, d):
    """A term map applied in its order, later terms on the outcome of earlier ones."""
    t = X.table(spark, d, "documents").select("doc_id", S.replace_terms("text", TERMS).alias("t"))
    return t.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@register("resolve_language_override", O.sql("SELECT DISTINCT source AS channel, 'es' AS lang FROM documents", "tags"))
def q_resolve_language_override(spark, d):
    """A language that the user asks for wins over stored and detected ones."""
    docs = X.table(spark, d, "documents")
    chans = docs.select(F.col("source").alias("channel"), F.lit("^en$").alias("stored_lang")).distinct()
    return ST.resolve_language(chans, ST.detect_language(X.fx_tags(docs)), override="es")
