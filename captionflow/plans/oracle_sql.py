"""DuckDB SQL twins of the fixtures and operators, used as the correctness oracle.

Written independently of the Spark code path: plain SQL over the registered
test-table views, with a recursive CTE (one step per cue) for the ordered folds.
``sql(final, *ctes)`` emits ``WITH RECURSIVE`` plus every CTE the query needs, in
dependency order.
"""

from __future__ import annotations

from ..functions import stopwords as sw

CTE: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, body: str, deps: list[str] | None = None, cols: str | None = None) -> None:
    CTE[name] = f"{name}{'(' + cols + ')' if cols else ''} AS (\n{body}\n)"
    DEPS[name] = deps or []


def sql(final: str, *names: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in DEPS[n]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH RECURSIVE\n" + ",\n".join(CTE[n] for n in order) + "\n" + final


def finish(text: str) -> str:
    return text.replace(STOPWORD_SLOT, sw.sql_values()) if STOPWORD_SLOT in text else text


VID = "'v' || lpad(cast(doc_id AS VARCHAR), 10, '0')"

# ---------------------------------------------------------------- fixtures
cte("_sent", r"""
SELECT doc_id, lang, trim(t) AS t, pos FROM (
  SELECT doc_id, lang, unnest(arr) AS t, generate_subscripts(arr, 1) AS pos
  FROM (SELECT doc_id, lang, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS arr FROM documents))
WHERE trim(t) <> ''""")
cte("_sent2", r"""
SELECT doc_id, lang, t, CAST(row_number() OVER w - 1 AS BIGINT) AS seq,
       CAST(len(string_split_regex(t, '\s+')) AS BIGINT) AS nw, lag(t) OVER w AS p, pos
FROM _sent WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""", ["_sent"])
cte("cues", f"""
SELECT {VID} AS video_id, lang, seq,
  CAST(2000 * (sum(nw) OVER w - nw) AS BIGINT) AS start_ms,
  CAST(2000 * sum(nw) OVER w AS BIGINT) AS end_ms,
  CASE WHEN seq % 4 = 1 THEN p || ' ' || t WHEN seq % 4 = 3 THEN '<i>' || t || '</i>' ELSE t END AS raw_text
FROM _sent2 WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ["_sent2"])
cte("videos", f"""
SELECT {VID} AS video_id, 'chan-' || {VID} AS title, 'Desconhecida' AS publish_date FROM documents""")

# ---------------------------------------------------------------- caption tiers and fold
cte("tiers", """
SELECT video_id, n_cues, duration_s,
  CASE WHEN duration_s < 1800 THEN 30 WHEN duration_s < 3600 THEN 60 ELSE 90 END AS window_s,
  CAST(CASE WHEN duration_s < 1800 THEN 0.25 WHEN duration_s < 3600 THEN 0.35 ELSE 0.50 END AS DOUBLE) AS threshold,
  CASE WHEN duration_s < 1200 THEN 3 WHEN duration_s < 2400 THEN 5 WHEN duration_s < 3600 THEN 7 ELSE 10 END
    AS min_segments
FROM (SELECT video_id, count(*) AS n_cues, CAST(floor(arg_max(end_ms, seq) / 1000) AS BIGINT) AS duration_s
      FROM cues GROUP BY video_id)""", ["cues"])
cte("_ct", r"""
SELECT c.video_id, c.lang, c.seq, c.start_ms, c.end_ms, t.window_s,
  row_number() OVER (PARTITION BY c.video_id ORDER BY c.seq) AS rn,
  trim(regexp_replace(replace(c.raw_text, chr(10), ' '), '<[^>]+>', '', 'g')) AS txt
FROM cues c JOIN tiers t USING (video_id)""", ["cues", "tiers"])
cte("_ctk", r"""
SELECT *, CASE WHEN txt = '' THEN []::VARCHAR[] ELSE string_split_regex(txt, '\s+') END AS toks FROM _ct""",
    ["_ct"])
# one recursion step per cue: kept tokens, window clock and raw window number are the state
cte("_fold", """
SELECT video_id, rn, txt, CASE WHEN txt <> '' THEN toks ELSE []::VARCHAR[] END, start_ms,
       CASE WHEN (end_ms - start_ms) // 1000 > window_s THEN 1 ELSE 0 END, 0
FROM _ctk WHERE rn = 1
UNION ALL
SELECT video_id, rn, clean, CASE WHEN clean <> '' THEN toks ELSE pk END,
       CASE WHEN (end_ms - clk) // 1000 > window_s THEN start_ms ELSE clk END,
       rw + CASE WHEN (end_ms - clk) // 1000 > window_s THEN 1 ELSE 0 END, rw
FROM (
  SELECT *, CASE WHEN len(pk) = 0 OR len(toks) = 0 THEN txt
                 WHEN ov / len(toks) > 0.5 THEN ''
                 ELSE array_to_string(toks[ov + 1:], ' ') END AS clean
  FROM (
    SELECT n.*, f.kept AS pk, f.nclock AS clk, f.nraw AS rw,
      coalesce(list_position(list_transform(range(1, len(n.toks) + 1),
                                            lambda i: coalesce(n.toks[i] = f.kept[i], false)), false) - 1,
               len(n.toks)) AS ov
    FROM _fold f JOIN _ctk n ON n.video_id = f.video_id AND n.rn = f.rn + 1))""",
    ["_ctk"], cols="video_id, rn, clean, kept, nclock, nraw, rawwin")
cte("_cw_raw", """
SELECT c.video_id, c.lang, c.seq, c.start_ms, c.end_ms, f.clean AS clean_text, f.rawwin
FROM _fold f JOIN _ctk c USING (video_id, rn)""", ["_fold"])
cte("_wraw", """
SELECT video_id, rawwin, any_value(lang) AS lang, arg_min(start_ms, seq) AS start_ms,
       arg_max(end_ms, seq) AS end_ms, count(*) AS n_cues,
       string_agg(clean_text, ' ' ORDER BY seq) FILTER (WHERE clean_text <> '') AS text
FROM _cw_raw GROUP BY video_id, rawwin""", ["_cw_raw"])
cte("_wnum", """
SELECT video_id, rawwin, CAST(dense_rank() OVER (PARTITION BY video_id ORDER BY rawwin) - 1 AS INTEGER) AS win
FROM _wraw WHERE text IS NOT NULL""", ["_wraw"])
cte("cue_windows", """
SELECT r.video_id, r.lang, r.seq, r.start_ms, r.end_ms, r.clean_text, n.win
FROM _cw_raw r LEFT JOIN _wnum n USING (video_id, rawwin)""", ["_cw_raw", "_wnum"])
cte("windows", """
SELECT w.video_id, w.lang, n.win, w.start_ms, w.end_ms, w.n_cues, w.text
FROM _wraw w JOIN _wnum n USING (video_id, rawwin)""", ["_wraw", "_wnum"])

# ---------------------------------------------------------------- TF-IDF and topics
SWKEY = ("CASE WHEN substr(coalesce({c}, 'pt'), 1, 2) IN ('pt', 'en', 'es') "
         "THEN substr(coalesce({c}, 'pt'), 1, 2) ELSE 'pt' END")
# the word lists are filled in by finish(), when oracle_sql() is called
STOPWORD_SLOT = "/*stopword rows*/"
cte("_sw", f"SELECT * FROM (VALUES {STOPWORD_SLOT}) AS t(swkey, term)")
cte("_tok", f"""
SELECT video_id, win, {SWKEY.format(c='lang')} AS swkey,
       unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
FROM windows""", ["windows"])
cte("_tf", """
SELECT video_id, win, term, count(*) AS tf FROM _tok t
WHERE NOT EXISTS (SELECT 1 FROM _sw s WHERE s.swkey = t.swkey AND s.term = t.term)
GROUP BY video_id, win, term""", ["_tok", "_sw"])
cte("_w", """
SELECT t.video_id, t.win, t.term, t.tf,
       t.tf * (ln((n.n + 1) / (d.df + 1)) + 1) AS w
FROM _tf t
JOIN (SELECT video_id, term, count(*) AS df FROM _tf GROUP BY ALL) d USING (video_id, term)
JOIN (SELECT video_id, count(*) AS n FROM windows GROUP BY ALL) n USING (video_id)""", ["_tf", "windows"])
cte("tfidf", """
SELECT video_id, win, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY video_id, win)) AS weight FROM _w""",
    ["_w"])
cte("sims", """
SELECT w.video_id, w.win, round(coalesce(d.dot, 0.0), 9) AS sim
FROM windows w LEFT JOIN (
  SELECT a.video_id, a.win, sum(a.weight * b.weight) AS dot
  FROM tfidf a JOIN tfidf b ON a.video_id = b.video_id AND a.term = b.term AND b.win = a.win - 1
  GROUP BY ALL) d USING (video_id, win)
WHERE w.win >= 1""", ["windows", "tfidf"])
cte("breaks", """
SELECT w.video_id, w.win,
  (w.win = 0 OR coalesce(s.sim < t.threshold, false)
   OR coalesce(s.rk <= greatest(t.min_segments - 1, 1), false)) AS is_break
FROM windows w JOIN tiers t USING (video_id)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sim, win) AS rk FROM sims) s
  USING (video_id, win)""", ["windows", "tiers", "sims"])
cte("segs", """
SELECT video_id, win, CAST(sum(CAST(is_break AS BIGINT)) OVER (PARTITION BY video_id ORDER BY win
                                                          ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg
FROM breaks""", ["breaks"])
# videos whose text is only stopwords have no vocabulary and give no output
cte("vocab_videos", "SELECT DISTINCT video_id FROM tfidf", ["tfidf"])
cte("seg_keywords", """
SELECT video_id, seg, string_agg(term, ' · ' ORDER BY rk) AS keywords FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, seg ORDER BY round(score, 9) DESC, term) AS rk
  FROM (SELECT t.video_id, s.seg, t.term, sum(t.weight) AS score
        FROM tfidf t JOIN segs s USING (video_id, win) GROUP BY ALL)
  WHERE score > 0 AND regexp_matches(term, '^\\p{L}{3,}$'))
WHERE rk <= 3 GROUP BY ALL""", ["tfidf", "segs"])
cte("seg_list", """
SELECT DISTINCT s.video_id, s.seg FROM segs s SEMI JOIN vocab_videos v USING (video_id)""",
    ["segs", "vocab_videos"])
cte("seg_stats", """
SELECT video_id, seg, start_ms, end_ms, n_cues,
  CASE WHEN start_ms // 1000 >= 3600
       THEN printf('%02d:%02d:%02d', start_ms // 1000 // 3600, start_ms // 1000 % 3600 // 60, start_ms // 1000 % 60)
       ELSE printf('%02d:%02d', start_ms // 1000 % 3600 // 60, start_ms // 1000 % 60) END AS start_ts,
  CASE WHEN n_cues < 2 THEN '~1 min'
       ELSE '~' || CAST(greatest(1, CAST(round_even(((end_ms - start_ms) // 1000) / 60.0, 0) AS BIGINT)) AS VARCHAR)
            || ' min' END AS duration
FROM (SELECT c.video_id, s.seg, arg_min(c.start_ms, c.seq) AS start_ms, arg_max(c.end_ms, c.seq) AS end_ms,
             count(*) AS n_cues
      FROM cue_windows c JOIN segs s USING (video_id, win) GROUP BY ALL)""", ["cue_windows", "segs"])
cte("seg_preview", f"""
SELECT video_id, seg,
  array_to_string(list(word ORDER BY rk) FILTER (WHERE rk <= 12), ' ')
    || CASE WHEN count(*) > 12 THEN '...' ELSE '' END AS preview
FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, seg ORDER BY win, pos) AS rk FROM (
    SELECT video_id, seg, win, swkey, word, pos FROM (
      SELECT w.video_id, s.seg, w.win, {SWKEY.format(c='w.lang')} AS swkey,
             unnest(string_split_regex(trim(w.text), '\\s+')) AS word,
             generate_subscripts(string_split_regex(trim(w.text), '\\s+'), 1) AS pos
      FROM windows w JOIN segs s USING (video_id, win))
    WHERE length(word) > 1) x
  WHERE NOT EXISTS (SELECT 1 FROM _sw k WHERE k.swkey = x.swkey AND k.term = lower(x.word)))
WHERE rk <= 13 GROUP BY ALL""", ["windows", "segs", "_sw"])


# ---------------------------------------------------------------- segment table, paragraphs, Markdown
cte("seg_table", """
SELECT l.video_id, l.seg, st.start_ms, st.start_ts, st.duration, coalesce(k.keywords, '') AS keywords,
  CASE WHEN l.seg = 1 THEN CASE WHEN coalesce(k.keywords, '') <> '' THEN 'Introdução — ' || k.keywords
                                ELSE 'Introdução' END
       ELSE CASE WHEN coalesce(k.keywords, '') <> '' THEN k.keywords ELSE 'Tópico ' || CAST(l.seg AS VARCHAR) END
  END AS label,
  coalesce(p.preview, '') AS preview
FROM seg_list l JOIN seg_stats st USING (video_id, seg)
LEFT JOIN seg_keywords k USING (video_id, seg) LEFT JOIN seg_preview p USING (video_id, seg)""",
    ["seg_list", "seg_stats", "seg_keywords", "seg_preview"])
cte("_pc", r"""
SELECT c.video_id, s.seg, c.seq, c.start_ms, c.end_ms, regexp_replace(c.clean_text, '\s+', ' ', 'g') AS t,
  row_number() OVER (PARTITION BY c.video_id ORDER BY c.seq) AS rn,
  coalesce(lead(s.seg) OVER (PARTITION BY c.video_id ORDER BY c.seq) <> s.seg, true) AS seg_last
FROM cue_windows c JOIN segs s USING (video_id, win)""", ["cue_windows", "segs"])
# state: open lines and paragraph start; a step emits the closed paragraph's lines
cte("_pfold", r"""
SELECT video_id, seg, rn, CASE WHEN fl THEN [] ELSE nl END, CASE WHEN fl THEN NULL ELSE ns END,
       CASE WHEN fl THEN nl END, ns
FROM (
  SELECT *, (len(nl) > 0 AND (seg_last OR (t <> '' AND (((end_ms - ns) // 1000 >= 60
              AND regexp_matches(t, '[.!?]["'']?\s*$')) OR (end_ms - ns) // 1000 >= 120)))) AS fl
  FROM (SELECT *, CASE WHEN t <> '' THEN [t] ELSE []::VARCHAR[] END AS nl,
               CASE WHEN t <> '' THEN start_ms END AS ns FROM _pc WHERE rn = 1))
UNION ALL
SELECT video_id, seg, rn, CASE WHEN fl THEN []::VARCHAR[] ELSE nl END, CASE WHEN fl THEN NULL ELSE ns END,
       CASE WHEN fl THEN nl END, ns
FROM (
  SELECT *, (len(nl) > 0 AND (seg_last OR (t <> '' AND (((end_ms - ns) // 1000 >= 60
              AND regexp_matches(t, '[.!?]["'']?\s*$')) OR (end_ms - ns) // 1000 >= 120)))) AS fl
  FROM (SELECT n.*, CASE WHEN n.t <> '' THEN list_append(f.lines, n.t) ELSE f.lines END AS nl,
               CASE WHEN n.t <> '' THEN coalesce(f.pstart, n.start_ms) ELSE f.pstart END AS ns
        FROM _pfold f JOIN _pc n ON n.video_id = f.video_id AND n.rn = f.rn + 1))""",
    ["_pc"], cols="video_id, seg, rn, lines, pstart, out_lines, out_start")
cte("paragraphs", r"""
SELECT video_id, seg, CAST(row_number() OVER (PARTITION BY video_id, seg ORDER BY rn) - 1 AS INTEGER) AS para,
       out_start AS start_ms, upper(left(body, 1)) || substr(body, 2) AS text
FROM (
  SELECT video_id, seg, rn, out_start,
    trim(regexp_replace(replace(list_reduce(out_lines, lambda acc, x:
      CASE WHEN strpos(lower(regexp_extract(acc, '[^\x01]*$')), lower(x)) > 0
             OR strpos(lower(x), lower(regexp_extract(acc, '[^\x01]*$'))) > 0
           THEN CASE WHEN length(x) > length(regexp_extract(acc, '[^\x01]*$'))
                     THEN regexp_replace(acc, '[^\x01]*$', '') || x ELSE acc END
           ELSE acc || chr(1) || x END), chr(1), ' '), ' {2,}', ' ', 'g')) AS body
  FROM _pfold WHERE out_lines IS NOT NULL)
WHERE body <> ''""", ["_pfold"])
cte("markdown", r"""
SELECT video_id, 0 AS part, CAST(0 AS BIGINT) AS seg, 0 AS para,
  '## ' || coalesce(v.title, video_id) || ' <a name="video-01"></a>' || chr(10) || '**URL:** https://youtube.com/watch?v='
  || video_id || '  ' || chr(10) || '**Data:** ' || coalesce(v.publish_date, 'Desconhecida') || '  ' || chr(10)
  || '**Duração:** ' || printf('%02d:%02d:%02d', t.duration_s // 3600, t.duration_s % 3600 // 60, t.duration_s % 60)
  || chr(10) || chr(10) AS fragment
FROM (SELECT DISTINCT video_id FROM seg_table) JOIN tiers t USING (video_id) LEFT JOIN videos v USING (video_id)
UNION ALL
SELECT video_id, 1, 0, 0, '### Segmentos de Tópicos (Timestamps)' || chr(10) FROM (SELECT DISTINCT video_id FROM seg_table)
UNION ALL
SELECT video_id, 2, seg, 0, '* `[' || start_ts || ']` **' || label || '** *(' || duration || ')* — ' || preview || chr(10)
FROM seg_table
UNION ALL
SELECT video_id, 3, 0, 0, chr(10) || '---' || chr(10) FROM (SELECT DISTINCT video_id FROM seg_table)
UNION ALL
SELECT video_id, 4, 0, 0, '### Transcrição Estruturada' || chr(10) || '> **Nota do Sistema:** Transcrição limpa.'
  || chr(10) || chr(10) FROM (SELECT DISTINCT video_id FROM seg_table)
UNION ALL
SELECT video_id, 5, seg, -1, '#### [' || printf('%02d:%02d:%02d', start_ms // 1000 // 3600, start_ms // 1000 % 3600 // 60,
  start_ms // 1000 % 60) || '] - Tópico: ' || label || chr(10) FROM seg_table
UNION ALL
SELECT p.video_id, 5, p.seg, p.para, '[' || CASE WHEN p.start_ms // 1000 >= 3600
    THEN printf('%02d:%02d:%02d', p.start_ms // 1000 // 3600, p.start_ms // 1000 % 3600 // 60, p.start_ms // 1000 % 60)
    ELSE printf('%02d:%02d', p.start_ms // 1000 % 3600 // 60, p.start_ms // 1000 % 60) END || '] ' || p.text
  || chr(10) || chr(10)
FROM paragraphs p SEMI JOIN (SELECT DISTINCT video_id FROM seg_table) s USING (video_id)""",
    ["seg_table", "tiers", "videos", "paragraphs"])

# ---------------------------------------------------------------- state fixtures
cte("obs", """
SELECT 'e' || lpad(CAST(user_id * 20 + k % 20 AS VARCHAR), 10, '0') AS video_id, event_id AS ord,
  CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d') WHEN 'error' THEN NULL ELSE 'N/A' END AS publish_date,
  CASE event_type WHEN 'click' THEN 'T' || CAST(event_id AS VARCHAR) WHEN 'purchase' THEN 'Avulso'
                  WHEN 'signup' THEN '' ELSE 'N/A' END AS title,
  (event_type = 'purchase' AND value > 20) AS subtitle_downloaded, (event_type = 'view') AS info_downloaded,
  (event_type = 'error' AND value > 50) AS has_no_subtitle,
  'PL' || CAST(event_id % 7 AS VARCHAR) AS playlist, 'ch' || CAST(user_id // 3 AS VARCHAR) AS channel_id,
  '@up' || CAST(user_id // 3 AS VARCHAR) AS uploader_id, 'Uploader up' || CAST(user_id // 3 AS VARCHAR) AS uploader,
  value AS duration_s, user_id AS view_count
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
cte("obs_rows", "SELECT * EXCLUDE (playlist), [playlist] AS playlists, CAST(NULL AS VARCHAR) AS channel FROM obs",
    ["obs"])
cte("listing", """
SELECT 'e' || lpad(CAST(o_orderkey // 4 AS VARCHAR), 10, '0') AS video_id, o_orderkey AS ord,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d') END AS upload_date,
  CASE WHEN o_orderkey % 3 = 1 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS epoch_s
FROM orders""")
cte("listing_rows", """
SELECT video_id, ord,
  CASE WHEN length(d8) = 8 THEN substr(d8, 1, 4) || '-' || substr(d8, 5, 2) || '-' || substr(d8, 7, 2)
       ELSE 'N/A' END AS publish_date,
  coalesce(nullif(title, ''), 'N/A') AS title,
  false AS subtitle_downloaded, false AS info_downloaded, false AS has_no_subtitle
FROM (SELECT *, CASE WHEN upload_date IS NULL OR upload_date = ''
                     THEN strftime(to_timestamp(epoch_s) AT TIME ZONE 'UTC', '%Y%m%d') ELSE upload_date END AS d8
      FROM listing)""", ["listing"])
cte("files", """
SELECT 'chan-v' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.' || lang || '.srt' AS path,
       'v' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS video_id, 1700000000 + doc_id % 97 AS mtime_s
FROM documents WHERE doc_id % 6 <> 0
UNION ALL
SELECT 'chan-v' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.' || lang || '-XX.srt',
       'v' || lpad(CAST(doc_id AS VARCHAR), 10, '0'), 1700000000 + doc_id % 89
FROM documents WHERE doc_id % 5 = 0
UNION ALL
SELECT 'chan-v' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '-' || lang || '.md',
       'v' || lpad(CAST(doc_id AS VARCHAR), 10, '0'), 1700000000 + doc_id % 83
FROM documents WHERE doc_id % 7 = 0""")
cte("inputs", """
SELECT page_id,
  CASE page_id % 5 WHEN 0 THEN url
                   WHEN 1 THEN 'https://www.youtube.com/watch?v=p' || lpad(CAST(page_id AS VARCHAR), 10, '0')
                   WHEN 2 THEN '@ch' || CAST(page_id AS VARCHAR)
                   WHEN 3 THEN 'playlist?list=PL' || CAST(page_id AS VARCHAR)
                   ELSE 'p' || lpad(CAST(page_id AS VARCHAR), 10, '0') END AS input, url
FROM pages""")
cte("tags", """
SELECT source AS channel, doc_id AS ord,
  CASE doc_id % 9 WHEN 0 THEN 'NA' WHEN 1 THEN upper(lang) || '-BR' WHEN 2 THEN lang || '_XX' ELSE lang END AS tag
FROM documents""")
cte("outcomes", """
SELECT video_id, CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END AS exit_code, (n % 3 <> 0) AS has_caption
FROM (SELECT DISTINCT video_id, CAST(regexp_extract(video_id, '(\\d+)$', 1) AS BIGINT) AS n FROM obs)""", ["obs"])
