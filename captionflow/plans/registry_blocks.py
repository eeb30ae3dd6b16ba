"""Registered Markdown-block and scalar-function queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocks as B
from ..sources import fixtures as X
from . import oracle_sql as O
from .registry import register


def _md(spark, d):
    return X.fx_md(X.table(spark, d, "documents"))


O.cte("md_docs", """
SELECT 'v' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS video_id,
  concat_ws(chr(10), '## Doc ' || CAST(doc_id AS VARCHAR), '',
            '* `code' || CAST(doc_id AS VARCHAR) || '` and **bold ' || lang || '**', '---', text, '```python',
            'x = ' || CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 11 <> 0 THEN '```' END) AS md
FROM documents""")
O.cte("md_lines", r"""
SELECT *, fences - CAST(is_fence AS BIGINT) AS before FROM (
  SELECT *, sum(CAST(is_fence AS BIGINT)) OVER (PARTITION BY video_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS fences
  FROM (SELECT *, starts_with(s, '```') AS is_fence FROM (
    SELECT video_id, ln, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM (
      SELECT video_id, unnest(string_split(md, chr(10))) AS line,
             generate_subscripts(string_split(md, chr(10)), 1) - 1 AS ln FROM md_docs))))""", ["md_docs"])
O.cte("md_blocks", r"""
SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ln) - 1 AS BIGINT) AS block_no, type,
  language, text FROM (
  SELECT video_id, ln, type, CAST(NULL AS VARCHAR) AS language,
    CASE type WHEN 'heading_1' THEN substr(s, 3) WHEN 'heading_2' THEN substr(s, 4) WHEN 'heading_3' THEN substr(s, 5)
              WHEN 'bulleted_list_item' THEN substr(s, 3) WHEN 'divider' THEN '' ELSE s END AS text
  FROM (SELECT *, CASE WHEN starts_with(s, '# ') THEN 'heading_1' WHEN starts_with(s, '## ') THEN 'heading_2'
                       WHEN starts_with(s, '### ') THEN 'heading_3'
                       WHEN starts_with(s, '* ') OR starts_with(s, '- ') OR starts_with(s, '• ') THEN 'bulleted_list_item'
                       WHEN s = '---' THEN 'divider' ELSE 'paragraph' END AS type
        FROM md_lines WHERE NOT is_fence AND before % 2 = 0 AND s <> '')
  UNION ALL
  SELECT c.video_id, c.ln, 'code', o.language, coalesce(b.text, '')
  FROM (SELECT video_id, before // 2 AS cid, ln FROM md_lines WHERE is_fence AND before % 2 = 1) c
  JOIN (SELECT video_id, before // 2 AS cid,
          CASE trim(substr(s, 4)) WHEN 'bash' THEN 'bash' WHEN 'python' THEN 'python' WHEN 'json' THEN 'json'
                                  WHEN 'md' THEN 'markdown' ELSE 'plain text' END AS language
        FROM md_lines WHERE is_fence AND before % 2 = 0) o USING (video_id, cid)
  LEFT JOIN (SELECT video_id, before // 2 AS cid, string_agg(line, chr(10) ORDER BY ln) AS text
             FROM md_lines WHERE NOT is_fence AND before % 2 = 1 GROUP BY ALL) b USING (video_id, cid))""",
      ["md_lines"])


@register("md_to_blocks", O.sql("SELECT * FROM md_blocks", "md_blocks"))
def q_md_to_blocks(spark, d):
    return B.md_to_blocks(_md(spark, d))


@register("code_fences", O.sql("SELECT video_id, block_no, language, CAST(length(text) AS INTEGER) AS n_chars, text FROM md_blocks "
                               "WHERE type = 'code'", "md_blocks"))
def q_code_fences(spark, d):
    """Code blocks only: fence pairs, their language and the lines between."""
    b = B.md_to_blocks(_md(spark, d)).filter(F.col("type") == "code")
    return b.select("video_id", "block_no", "language", F.length("text").alias("n_chars"), "text")


@register("classify_line", O.sql("SELECT type, count(*) AS n FROM md_blocks GROUP BY ALL", "md_blocks"))
def q_classify_line(spark, d):
    return B.md_to_blocks(_md(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


O.cte("md_spans", r"""
SELECT video_id, block_no, CAST(row_number() OVER (PARTITION BY video_id, block_no ORDER BY tp, ci) - 1 AS INTEGER)
  AS span_no, substr(body, ci * 2000 + 1, 2000) AS content, bold, code FROM (
  SELECT *, unnest(generate_series(0, (length(body) - 1) // 2000)) AS ci FROM (
    SELECT video_id, block_no, tp, bold, code,
      CASE WHEN bold THEN substr(t, 3, length(t) - 4) WHEN code THEN substr(t, 2, length(t) - 2) ELSE t END AS body
    FROM (SELECT *, starts_with(t, '**') AND ends_with(t, '**') AS bold,
                 NOT (starts_with(t, '**') AND ends_with(t, '**')) AND starts_with(t, '`') AND ends_with(t, '`') AS code
          FROM (SELECT video_id, block_no, unnest(toks) AS t, generate_subscripts(toks, 1) AS tp FROM (
                  SELECT video_id, block_no, regexp_extract_all(text, '(\*\*.*?\*\*|`.*?`|[^*`]+)', 1) AS toks
                  FROM md_blocks WHERE type NOT IN ('code', 'divider')))))
  WHERE length(body) > 0)
UNION ALL
SELECT video_id, block_no, 0, text, false, false FROM md_blocks WHERE type = 'code'""", ["md_blocks"])


@register("rich_text", O.sql("SELECT * FROM md_spans", "md_spans"))
def q_rich_text(spark, d):
    return B.rich_text(B.md_to_blocks(_md(spark, d)))


@register("chunk_text", O.sql("""
SELECT video_id, block_no, count(*) AS n_pieces, CAST(max(length(content)) AS INTEGER) AS longest FROM md_spans
GROUP BY ALL""",
                              "md_spans"))
def q_chunk_text(spark, d):
    """Span pieces per block after cutting at 2000 characters."""
    s = B.rich_text(B.md_to_blocks(_md(spark, d)))
    return s.groupBy("video_id", "block_no").agg(F.count(F.lit(1)).alias("n_pieces"),
                                                 F.max(F.length("content")).alias("longest"))


@register("block_batches", O.sql("""
SELECT video_id, CAST(block_no // 100 AS INTEGER) AS batch, count(*) AS n_children, min(block_no) AS first_block,
  max(block_no) AS last_block FROM md_blocks GROUP BY ALL""", "md_blocks"))
def q_block_batches(spark, d):
    b = B.block_batches(B.md_to_blocks(_md(spark, d)))
    return b.groupBy("video_id", "batch").agg(F.count(F.lit(1)).alias("n_children"),
                                              F.min("block_no").alias("first_block"),
                                              F.max("block_no").alias("last_block"))


O.cte("payload_spans", """
SELECT video_id, CAST(block_no // 100 AS INTEGER) AS batch, count(*) AS n_spans,
  md5(string_agg(content || CASE WHEN bold THEN '+b' WHEN code THEN '+c' ELSE '' END, chr(31) ORDER BY block_no, span_no)) AS spans
FROM md_spans GROUP BY ALL""", ["md_spans"])


@register("page_payloads", O.sql(f"""
SELECT b.*, coalesce(s.n_spans, 0) AS n_spans, coalesce(s.spans, md5('')) AS spans,
  CASE WHEN b.batch = 0 THEN 'db' END AS database_id,
  CASE WHEN b.batch = 0 THEN CASE WHEN doc_id % 7 = 0 THEN '{B.UNTITLED}' ELSE 'Doc ' || CAST(doc_id AS VARCHAR) END END AS page_title,
  CASE WHEN b.batch = 0 THEN 'https://www.youtube.com/watch?v=' || b.video_id END AS url
FROM (SELECT video_id, CAST(block_no // 100 AS INTEGER) AS batch, count(*) AS n_children,
        string_agg(type, ',' ORDER BY block_no) AS types,
        coalesce(string_agg(language, ',' ORDER BY block_no) FILTER (WHERE type = 'code'), '') AS languages
      FROM md_blocks GROUP BY ALL) b
LEFT JOIN payload_spans s USING (video_id, batch)
JOIN (SELECT doc_id, 'v' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS video_id FROM documents) d USING (video_id)""",
                                 "md_blocks", "payload_spans"))
def q_page_payloads(spark, d):
    """JSON request bodies per (document, batch of 100 blocks), parsed back into columns:
    page properties, the blocks' types and languages, and all spans with their marks."""
    docs = X.table(spark, d, "documents")
    videos = docs.select(F.concat(F.lit("v"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("video_id"),
                         F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(
                             F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).alias("title"))
    made = B.page_payloads(B.md_to_blocks(X.fx_md(docs)), videos, database_id="db")
    body = F.from_json("payload", "parent struct<database_id: string>, properties struct<Name: struct<title: array<struct<text: "
                       "struct<content: string>>>>, URL: struct<url: string>>, children array<map<string, string>>", {"mode": "FAILFAST"})
    block = "rich_text array<struct<type: string, text: struct<content: string>, annotations: struct<bold: boolean, code: boolean>>>, " \
            "language string"
    kids = made.select("video_id", "batch", body.alias("p")).select(
        "video_id", "batch", "p", F.transform("p.children", lambda c: F.struct(
            c["type"].alias("type"), F.from_json(c[c["type"]], block, {"mode": "FAILFAST"}).alias("b"))).alias("c"))
    marks = F.flatten(F.transform("c", lambda c: F.transform(F.coalesce(c["b"]["rich_text"], F.array()), lambda s: F.concat(
        s["text"]["content"], F.when(s["annotations"]["bold"], "+b").when(s["annotations"]["code"], "+c").otherwise("")))))
    codes = F.filter("c", lambda c: c["type"] == "code")
    return kids.select(
        "video_id", "batch", F.size("c").cast("long").alias("n_children"), F.array_join(F.transform("c", lambda c: c["type"]), ",").alias("types"),
        F.array_join(F.transform(codes, lambda c: c["b"]["language"]), ",").alias("languages"),
        F.size(marks).cast("long").alias("n_spans"), F.md5(F.array_join(marks, "\x1f")).alias("spans"),
        F.col("p.parent.database_id").alias("database_id"), F.get(F.col("p.properties.Name.title"), 0)["text"]["content"].alias("page_title"),
        F.col("p.properties.URL.url").alias("url"))


@register("scalar_text", O.sql(r"""
SELECT doc_id,
  md5(trim(regexp_replace(replace(text, chr(10), ' '), '<[^>]+>', '', 'g'))) AS strip_tags,
  md5(regexp_replace(text, '\s+', ' ', 'g')) AS collapse_ws,
  upper(left(lower(fl), 1)) || substr(lower(fl), 2) AS upper_first,
  regexp_matches(fl, '[.!?]["'']?\s*$') AS ends_sentence,
  CASE WHEN n_chars >= 3600 THEN printf('%02d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60)
       ELSE printf('%02d:%02d', n_chars % 3600 // 60, n_chars % 60) END AS smart_ts,
  printf('%02d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS hms,
  regexp_matches(lower(split_part(fl, ' ', 1)), '^\p{L}{3,}$') AS is_alpha_term,
  'https://youtube.com/watch?v=' || 'v' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS video_url,
  lang AS parse_lang_regex,
  CASE doc_id % 5 WHEN 0 THEN 'bash' WHEN 1 THEN 'python' WHEN 2 THEN 'json' WHEN 3 THEN 'markdown'
                  ELSE 'plain text' END AS fence_language,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'Introdução — ' || lang ELSE 'Introdução' END
       ELSE CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Tópico ' || CAST(doc_id % 3 + 1 AS VARCHAR) END END AS topic_label,
  CAST(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - 1) // 2000 + 1 END AS INTEGER) AS n_chunks
FROM (SELECT *, split_part(text, chr(10), 1) AS fl FROM documents)""", "md_docs"))
def q_scalar_text(spark, d):
    """The scalar Column functions projected over every document."""
    docs = X.table(spark, d, "documents")
    fl = F.split("text", "\n", 2)[0]
    n = F.col("n_chars")
    fence_in = F.element_at(F.array(*[F.lit(x) for x in ("bash", "python", "json", "md")] + [F.col("lang")]),
                            (F.col("doc_id") % 5 + 1).cast("int"))
    seg = (F.col("doc_id") % 3 + 1).cast("long")
    kw = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit(""))
    return docs.select(
        "doc_id",
        F.md5(S.strip_tags("text")).alias("strip_tags"),
        F.md5(S.collapse_ws("text")).alias("collapse_ws"),
        S.upper_first(F.lower(fl)).alias("upper_first"),
        S.ends_sentence(fl).alias("ends_sentence"),
        S.smart_ts(n * 1000).alias("smart_ts"),
        S.hms(n * 1000).alias("hms"),
        S.is_alpha_term(F.lower(F.split(fl, " ", 2)[0])).alias("is_alpha_term"),
        S.video_url(F.concat(F.lit("v"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))).alias("video_url"),
        S.parse_lang_regex(F.concat(F.lit("^"), F.col("lang"), F.lit("$"))).alias("parse_lang_regex"),
        S.fence_language(fence_in).alias("fence_language"),
        S.topic_label(seg, kw).alias("topic_label"),
        F.size(S.chunk_text("text")).alias("n_chunks"))
