"""Registered file-inventory, planning, block and scalar queries with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import files as FL
from ..operators import state as ST
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as X
from ..sources import state_files as SF
from ..sources.documents import write_documents
from . import oracle_sql as O
from .registry import register

AS_OF = X.OUTCOME_AS_OF
ALLOWED_HOSTS = ("example.com", "example.org")


def _docs(spark, d):
    return X.table(spark, d, "documents")


def _files(spark, d):
    return SF.describe_files(X.fx_files(_docs(spark, d)))


O.cte("files_desc", r"""
SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, name,
  lower(regexp_extract(name, '\.([A-Za-z0-9]+)$', 1)) AS ext,
  regexp_extract(regexp_replace(name, '(\.info)?\.[A-Za-z0-9]+$', ''),
                 '([A-Za-z0-9_-]{11})(?:[.-][A-Za-z]{2}(?:[-_][A-Za-z]{2})?)?(?:\.info)?$', 1) AS video_id,
  CASE WHEN regexp_extract(name, '-([a-z]{2}(-[A-Z]{2})?)\.srt$', 1) = '' THEN 'pt'
       ELSE lower(regexp_extract(name, '-([a-z]{2}(-[A-Z]{2})?)\.srt$', 1)) END AS lang, mtime_s
FROM (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS name, mtime_s FROM files)""", ["files"])


@register("extract_video_id", O.sql("SELECT path, video_id FROM files_desc", "files_desc"))
def q_extract_video_id(spark, d):
    return _files(spark, d).select("path", "video_id")


@register("extract_lang", O.sql("SELECT path, lang FROM files_desc", "files_desc"))
def q_extract_lang(spark, d):
    return _files(spark, d).select("path", "lang")


O.cte("present", """
SELECT video_id, bool_or(ends_with(path, '.srt')) AS has_srt, bool_or(ends_with(path, '.md')) AS has_md
FROM files_desc GROUP BY ALL""", ["files_desc"])


@register("files_present", O.sql("SELECT * FROM present", "present"))
def q_files_present(spark, d):
    return ST.files_present(_files(spark, d))


@register("pick_caption_variant", O.sql(r"""
SELECT video_id, path, keep, CASE WHEN keep THEN
    CASE WHEN starts_with(suffix, '.') AND len(string_split(suffix, '.')) - 1 >= 2
         THEN 'chan-' || video_id || '-' || ltrim(suffix, '.') ELSE name END END AS new_name, n_variants
FROM (
  SELECT f.*, f.path = b.kp AS keep, b.n_variants, substr(f.name, length('chan-' || f.video_id) + 1) AS suffix
  FROM (SELECT * FROM files_desc WHERE ends_with(name, '.srt') AND starts_with(name, 'chan-' || video_id)) f
  JOIN (SELECT video_id, arg_min(path, (length(path), path)) AS kp, count(*) AS n_variants
        FROM files_desc WHERE ends_with(name, '.srt') AND starts_with(name, 'chan-' || video_id) GROUP BY ALL) b
  USING (video_id))""", "files_desc"))
def q_pick_caption_variant(spark, d):
    return FL.pick_caption_variant(_files(spark, d), "chan")


def _regen(spark, d):
    return SF.describe_files(X.fx_regen_files(_docs(spark, d)))


O.cte("regen_desc", O.CTE["files_desc"].split(" AS (\n", 1)[1].rsplit("\n)", 1)[0].replace(
    "FROM files)", """FROM (SELECT CASE WHEN mtime_s % 2 = 0 THEN 'archive/' || path ELSE path END AS path, mtime_s
      FROM files))"""), ["files"])
O.cte("regen_inputs", """
SELECT path, name, video_id, CASE WHEN dir = 'archive' THEN 'archive/' ELSE './' END AS origin,
  CASE WHEN dir = 'archive' THEN 0 ELSE 1 END AS priority
FROM regen_desc WHERE ext = 'srt' AND dir IN ('archive', '')""", ["regen_desc"])


@register("list_files", O.sql("""
SELECT dir, name, ext, video_id, lang FROM regen_desc WHERE dir IN ('archive', '')""", "regen_desc"))
def q_list_files(spark, d):
    """FX-REGEN written as files (every third one empty) with some in a tool folder and
    some three levels deep, then listed."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    files = X.fx_regen_files(_docs(spark, d))
    extra = files.where("mtime_s % 5 = 0")
    every = files.union(extra.withColumn("path", F.concat(F.lit(".git/"), "path"))) \
        .union(extra.withColumn("path", F.concat(F.lit("archive/deep/"), "path")))
    write_documents(every.select(F.col("path").alias("file"), F.lit(0).alias("k"),
                                 F.when(F.col("mtime_s") % 3 != 0, F.col("path")).alias("piece")), path, "k")
    return SF.list_files(spark, path).select("dir", "name", "ext", "video_id", "lang")


@register("scan_regen_inputs", O.sql("SELECT * FROM regen_inputs", "regen_inputs"))
def q_scan_regen_inputs(spark, d):
    return FL.scan_regen_inputs(_regen(spark, d))


@register("files_by_origin", O.sql(r"""
SELECT origin, count(*) AS files, count(*) FILTER (WHERE m.stem IS NOT NULL) AS skipped,
  count(*) FILTER (WHERE m.stem IS NULL) AS to_convert
FROM regen_inputs i LEFT JOIN (SELECT DISTINCT regexp_replace(path, '\.md$', '') AS stem FROM regen_desc
                               WHERE ext = 'md') m ON m.stem = regexp_replace(i.path, '\.srt$', '')
GROUP BY ALL""", "regen_inputs", "regen_desc"))
def q_files_by_origin(spark, d):
    f = _regen(spark, d)
    return FL.files_by_origin(FL.scan_regen_inputs(f), f)


O.cte("vstate", """
SELECT 'v' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS video_id, doc_id AS ord,
  CASE doc_id % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN '2024-01-28' WHEN 2 THEN '2023-12-01' ELSE 'bad-date' END
    AS publish_date, 'Doc ' || CAST(doc_id AS VARCHAR) AS title,
  doc_id % 4 = 0 AS subtitle_downloaded, false AS info_downloaded, doc_id % 9 = 0 AS has_no_subtitle,
  source AS channel_id
FROM documents""")


O.cte("stored_titles", """
SELECT CASE WHEN ord % 2 = 0 THEN video_id ELSE 'x' || substr(video_id, 2) END AS video_id,
  arg_max(coalesce(CASE WHEN ord % 5 = 0 THEN '' ELSE title END, ''), ord) AS title
FROM vstate GROUP BY ALL""", ["vstate"])


@register("lookup_titles", O.sql(r"""
SELECT i.path, i.video_id, coalesce(t.title, regexp_replace(i.name, '\.[^.]*$', '')) AS title
FROM regen_inputs i LEFT JOIN stored_titles t USING (video_id)""", "regen_inputs", "stored_titles"))
def q_lookup_titles(spark, d):
    """Titles for regeneration inputs from a state where some titles are empty
    and half of the rows belong to videos without files (file stem fallback)."""
    st = X.fx_title_state(_docs(spark, d))
    return FL.lookup_titles(FL.scan_regen_inputs(_regen(spark, d)), st)


O.cte("planned", """
SELECT s.video_id, s.channel_id, s.publish_date,
  CASE WHEN s.subtitle_downloaded THEN 'skip_done' WHEN s.has_no_subtitle THEN 'skip_no_subtitle'
       WHEN coalesce(p.has_srt, false) AND NOT coalesce(p.has_md, false) THEN 'convert'
       WHEN coalesce(p.has_srt, false) OR coalesce(p.has_md, false) THEN 'skip_on_disk' ELSE 'fetch' END AS action,
  s.info_downloaded, s.subtitle_downloaded, s.has_no_subtitle
FROM vstate s LEFT JOIN present p USING (video_id)""", ["vstate", "present"])
O.cte("planned2", """
SELECT video_id, channel_id, publish_date, action, has_no_subtitle,
  info_downloaded OR action IN ('convert', 'skip_on_disk') AS info_downloaded,
  subtitle_downloaded OR action IN ('convert', 'skip_on_disk') AS subtitle_downloaded
FROM planned""", ["planned"])


def _vstate(spark, d):
    """FX-VSTATE with the false flags of odd rows left null."""
    return X.fx_vstate(_docs(spark, d)).withColumns({f: F.when(F.col(f) | (F.col("ord") % 2 == 0), F.col(f)) for f in ST.FLAGS})


def _plan(spark, d):
    return ST.plan_work(_vstate(spark, d), ST.files_present(_files(spark, d)))


@register("plan_work", O.sql("SELECT video_id, action, info_downloaded, subtitle_downloaded FROM planned2", "planned2"))
def q_plan_work(spark, d):
    return _plan(spark, d).select("video_id", "action", "info_downloaded", "subtitle_downloaded")


@register("plan_work_audio", O.sql("""
SELECT s.video_id, p.action, s.info_downloaded OR p.action <> 'fetch' AS info_downloaded,
  s.subtitle_downloaded OR p.action <> 'fetch' AS subtitle_downloaded
FROM vstate s JOIN (
  SELECT video_id, CASE WHEN coalesce(p.has_srt, false) AND NOT coalesce(p.has_md, false) THEN 'convert'
    WHEN coalesce(p.has_srt, false) OR coalesce(p.has_md, false) THEN 'skip_on_disk' ELSE 'fetch' END AS action
  FROM vstate LEFT JOIN present p USING (video_id)) p USING (video_id)""", "vstate", "present"))
def q_plan_work_audio(spark, d):
    """The plan when only audio is wanted: stored flags skip nothing."""
    plan = ST.plan_work(_vstate(spark, d), ST.files_present(_files(spark, d)), audio_only=True)
    return plan.select("video_id", "action", "info_downloaded", "subtitle_downloaded")


O.cte("voutcomes", """
SELECT 'v' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS video_id, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END
  AS exit_code, doc_id % 3 <> 0 AS has_caption FROM documents""")
O.cte("applied", f"""
SELECT p.video_id, p.channel_id,
  CASE WHEN p.action <> 'fetch' THEN 'skipped' WHEN o.exit_code IS NULL THEN 'pending'
       WHEN o.exit_code = 0 AND o.has_caption THEN 'downloaded' WHEN o.exit_code = 0 THEN 'skipped'
       ELSE 'error' END AS outcome,
  p.subtitle_downloaded OR coalesce(p.action = 'fetch' AND o.exit_code = 0 AND o.has_caption, false)
    AS subtitle_downloaded,
  p.has_no_subtitle OR coalesce(p.action = 'fetch' AND o.exit_code = 0 AND NOT o.has_caption
    AND coalesce(date_diff('day', try_strptime(p.publish_date, '%Y-%m-%d')::DATE, DATE '{AS_OF}') > 7, true), false)
    AS has_no_subtitle
FROM planned2 p LEFT JOIN voutcomes o USING (video_id)""", ["planned2", "voutcomes"])


def _applied(spark, d):
    outcomes = X.fx_voutcomes(_docs(spark, d)).withColumn("has_caption", F.when(F.col("has_caption"), True))  # else null
    return ST.apply_outcomes(_plan(spark, d), outcomes, AS_OF)


@register("apply_outcomes", O.sql("SELECT video_id, outcome, subtitle_downloaded, has_no_subtitle FROM applied",
                                  "applied"))
def q_apply_outcomes(spark, d):
    return _applied(spark, d).select("video_id", "outcome", "subtitle_downloaded", "has_no_subtitle")


@register("session_summary", O.sql("""
SELECT channel_id, count(*) FILTER (WHERE outcome = 'downloaded') AS downloaded,
  count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'error') AS error,
  count(*) AS total FROM applied GROUP BY ALL""", "applied"))
def q_session_summary(spark, d):
    return ST.session_summary(_applied(spark, d))


# ------------------------------------------------------------------ state files, hosts
def _json_files(spark, d):
    return SF.describe_files(X.fx_json_files(_docs(spark, d)))


MODERN, LEGACY = SF.STATE_PREFIXES
O.cte("json_files", f"""
SELECT 'd' || CAST(doc_id // 50 AS VARCHAR) || '/' ||
  CASE WHEN doc_id % 97 = 0 THEN 'package.json' WHEN doc_id % 10 = 0 THEN '{MODERN}' || source || '.json'
       WHEN doc_id % 10 = 1 THEN '{LEGACY}' || source || '.json'
       WHEN doc_id % 10 <= 5 THEN 'chan-v' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.info.json'
       ELSE 'notes' || CAST(doc_id % 10 AS VARCHAR) || '.json' END AS path,
  1700000000 + (doc_id * 37) % 1009 AS mtime_s
FROM documents""")
O.cte("json_desc", O.CTE["files_desc"].split(" AS (\n", 1)[1].rsplit("\n)", 1)[0].replace(
    "FROM files)", "FROM json_files)"), ["json_files"])


@register("route_state_files", O.sql(f"""
SELECT path, name, CASE WHEN starts_with(name, '{MODERN}') OR starts_with(name, '{LEGACY}') THEN 'state'
  WHEN regexp_matches(name, '[A-Za-z0-9_-]{{11}}') THEN 'metadata' ELSE 'ignore' END AS route
FROM json_desc WHERE ext = 'json'
  AND name NOT IN ('package.json', 'package-lock.json', 'requirements.json', 'env.json')""", "json_desc"))
def q_route_state_files(spark, d):
    return SF.route_state_files(_json_files(spark, d)).select("path", "name", "route")


O.cte("latest", f"""
SELECT dir, arg_max(path, (mtime_s, path)) AS path, arg_max(name, (mtime_s, path)) AS name FROM (
  SELECT *, min(t) OVER (PARTITION BY dir) AS bt FROM (
    SELECT *, CASE WHEN starts_with(name, '{MODERN}') THEN 0 WHEN starts_with(name, '{LEGACY}') THEN 1 END AS t
    FROM json_desc WHERE ext = 'json') WHERE t IS NOT NULL)
WHERE t = bt GROUP BY ALL""", ["json_desc"])


@register("latest_file", O.sql("SELECT * FROM latest", "latest"))
def q_latest_file(spark, d):
    return SF.latest_file(_json_files(spark, d))


@register("infer_channel", O.sql(f"""
SELECT dir, path, coalesce(CASE WHEN length(path) % 2 = 0 THEN '@doc' || CAST(length(path) AS VARCHAR) END,
  '@' || regexp_extract(name, '(?:{MODERN}|{LEGACY})(.+)\\.json', 1)) AS channel FROM latest""", "latest"))
def q_infer_channel(spark, d):
    f = _json_files(spark, d)
    return FL.infer_channel(f, X.fx_state_paths(f.select("path").distinct()))


@register("filter_hosts", O.sql("""
SELECT page_id, value FROM (
  SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '# page ' || CAST(page_id AS VARCHAR) WHEN page_id % 11 = 0 THEN ''
    WHEN page_id % 5 = 0 THEN concat_ws(chr(9), host, 'TRUE', '/')
    ELSE concat_ws(chr(9), host, 'TRUE', '/', 'FALSE', CAST(page_id * 1000 AS VARCHAR), 'k' || CAST(page_id AS VARCHAR),
                   'v') END AS value
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages))
WHERE starts_with(value, '#') OR trim(value) = ''
   OR (len(string_split(value, chr(9))) >= 6
       AND (contains(trim(split_part(value, chr(9), 1)), 'example.com')
            OR contains(trim(split_part(value, chr(9), 1)), 'example.org')))""", "inputs"))
def q_filter_hosts(spark, d):
    return FL.filter_hosts(X.fx_host_lines(X.table(spark, d, "pages")), ALLOWED_HOSTS)


SYNC_CHANNEL = "src1"


@register("pick_state_file", O.sql(f"""
SELECT d.dir, coalesce(ex, CASE WHEN n = 1 THEN mn END, ct, nw, d.dir || '/{MODERN}{SYNC_CHANNEL}.json') AS path,
  a.dir IS NULL AS is_new
FROM (SELECT DISTINCT dir FROM json_desc) d LEFT JOIN (
  SELECT dir, count(*) AS n, max(CASE WHEN name = '{MODERN}{SYNC_CHANNEL}.json' THEN path END) AS ex,
    min(path) AS mn, min(CASE WHEN contains(name, '{SYNC_CHANNEL}') THEN path END) AS ct,
    arg_max(path, (mtime_s, path)) AS nw
  FROM (SELECT * FROM (
          SELECT *, min(t) OVER (PARTITION BY dir) AS bt FROM (
            SELECT *, CASE WHEN starts_with(name, '{MODERN}') THEN 0 WHEN starts_with(name, '{LEGACY}') THEN 1 END
              AS t FROM json_desc WHERE ext = 'json') WHERE t IS NOT NULL) WHERE t = bt)
  GROUP BY dir) a USING (dir)""", "json_desc"))
def q_pick_state_file(spark, d):
    """Sync-time choice of the state file per folder for one channel."""
    return SF.pick_state_file(_json_files(spark, d), SYNC_CHANNEL)


@register("latest_file_of_channel", O.sql(f"""
SELECT dir, arg_min(path, r) AS path, arg_min(name, r) AS name FROM (
  SELECT *, CASE name WHEN '{MODERN}{SYNC_CHANNEL}.json' THEN 0 WHEN '{LEGACY}{SYNC_CHANNEL}.json' THEN 1 END AS r
  FROM json_desc)
WHERE r IS NOT NULL GROUP BY dir""", "json_desc"))
def q_latest_file_of_channel(spark, d):
    """Per folder the state file that bears the channel's name, the modern one first."""
    return SF.latest_file(_json_files(spark, d), channel=SYNC_CHANNEL)
