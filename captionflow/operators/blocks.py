"""Markdown -> typed document blocks -> rich-text spans -> request batches.

Line order inside a document is kept with positions from ``posexplode``; the fence
state (inside/outside a code block) is a running count of fence lines. A document is
one string in one row before, so its lines fit one task; documents are the unit that
spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

BATCH_SIZE = 100
SPAN_CHARS = 2000
UNTITLED = "Sem Título"


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def md_to_blocks(md: DataFrame, id_col: str = "video_id", text_col: str = "md") -> DataFrame:
    """``(video_id, block_no, type, language, text)``; one row per block.

    Blank lines outside code are skipped; fence lines toggle code mode; the lines
    between a fence pair form one ``code`` block (an unclosed block is dropped);
    other lines are headings 1-3, bullets, dividers or paragraphs. One exchange by
    document: fence count, block grouping and numbering all ride on it."""
    lines = md.select(F.col(id_col).alias("video_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("ln", "line"))
    lines = lines.withColumn("s", _strip(F.col("line"))).withColumn("is_fence", F.col("s").startswith("```"))
    in_order = Window.partitionBy("video_id").orderBy("ln")
    # fences strictly before this line; odd = inside a code block
    before = F.coalesce(F.sum(F.col("is_fence").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("before", before)
    odd = F.col("before") % 2 == 1
    code = F.col("is_fence") | odd
    group = F.when(code, -1 - F.floor(F.col("before") / 2)).otherwise(F.col("ln"))
    part = lines.filter(code | (F.col("s") != "")).select("video_id", "ln", "line", "s", "is_fence", odd.alias("odd"),
                                                         code.alias("code"), group.alias("grp"))
    # a code group: its opening fence, its lines, its closing fence; any other group is one line
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_fence"), F.struct("ln", "line")))), lambda x: x["line"])
    g = part.groupBy("video_id", "grp").agg(
        F.bool_or("code").alias("code"), F.max("ln").alias("ln"), F.min_by("s", "ln").alias("s"),
        F.bool_or(F.col("is_fence") & F.col("odd")).alias("closed"), F.array_join(body, "\n").alias("body"))
    kind = F.when(F.col("code"), "code").otherwise(S.classify_line("s"))
    blocks = g.filter(~F.col("code") | F.col("closed")).select(
        "video_id", "ln", "code", "s", "body", kind.alias("type"),
        F.when(F.col("code"), S.fence_language(F.substring("s", 4, 1 << 30))).alias("language"))
    return blocks.select("video_id", (F.row_number().over(in_order) - 1).cast("long").alias("block_no"), "type", "language",
                         F.when(F.col("code"), F.col("body")).otherwise(S.line_body("s", "type")).alias("text"))


def rich_text(blocks: DataFrame, terms: dict | None = None, size: int = SPAN_CHARS) -> DataFrame:
    """``(video_id, block_no, span_no, content, bold, code)``: one row per span.

    Code blocks keep their text as one unparsed span; dividers have none."""
    spans = F.when(F.col("type") == "code",
                   F.array(F.struct(F.col("text").alias("content"), F.lit(False).alias("bold"),
                                    F.lit(False).alias("code"))))
    spans = spans.when(F.col("type") == "divider", F.array().cast(
        "array<struct<content:string,bold:boolean,code:boolean>>")).otherwise(S.rich_text_spans("text", terms, size))
    return (blocks.select("video_id", "block_no", F.posexplode(spans).alias("span_no", "s"))
            .select("video_id", "block_no", "span_no", F.col("s.content").alias("content"),
                    F.col("s.bold").alias("bold"), F.col("s.code").alias("code")))


def block_batches(blocks: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Blocks with their request batch: ``floor(block_no / size)``."""
    return blocks.withColumn("batch", F.floor(F.col("block_no") / size).cast("int"))


def _block_json(spans_df: DataFrame, blocks: DataFrame) -> DataFrame:
    span = F.struct(F.lit("text").alias("type"), F.struct(F.col("content").alias("content")).alias("text"),
                    F.when(F.col("bold") | F.col("code"),
                           F.struct(F.when(F.col("bold"), F.lit(True)).alias("bold"),
                                    F.when(F.col("code"), F.lit(True)).alias("code"))).alias("annotations"))
    rt = spans_df.groupBy("video_id", "block_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("span_no", span.alias("s")))), lambda x: x["s"]).alias("rt"))
    b = blocks.join(rt, ["video_id", "block_no"], "left")
    rt_arr = F.coalesce("rt", F.array())
    body = F.when(F.col("type") == "code", F.to_json(F.struct(rt_arr.alias("rich_text"), F.col("language").alias("language")))) \
        .when(F.col("type") == "divider", F.lit("{}")) \
        .otherwise(F.to_json(F.struct(rt_arr.alias("rich_text"))))
    js = F.concat(F.lit('{"object":"block","type":"'), F.col("type"), F.lit('","'), F.col("type"), F.lit('":'),
                  body, F.lit("}"))
    return b.select("video_id", "block_no", js.alias("block_json"))


def page_payloads(blocks: DataFrame, videos: DataFrame, database_id: str = "", terms: dict | None = None,
                  size: int = BATCH_SIZE) -> DataFrame:
    """``(video_id, batch, n_children, payload)``: one JSON request body per batch
    of at most ``size`` blocks; batch 0 carries the page properties (title with
    ``replace_terms``, empty -> ``Sem Título``; watch URL)."""
    bj = _block_json(rich_text(blocks, terms), blocks)
    bb = block_batches(bj, size)
    g = bb.groupBy("video_id", "batch").agg(
        F.count(F.lit(1)).alias("n_children"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block_json"))),
                                 lambda x: x["block_json"]), ",").alias("children"))
    v = videos.select("video_id", F.coalesce(F.nullif(S.replace_terms("title", terms), F.lit("")),
                                             F.lit(UNTITLED)).alias("title"))
    props = F.to_json(F.struct(
        F.struct(F.lit(database_id).alias("database_id")).alias("parent"),
        F.struct(F.struct(F.array(F.struct(F.struct(F.col("title").alias("content")).alias("text"))).alias("title"))
                 .alias("Name"),
                 F.struct(S.video_url("video_id", www=True).alias("url")).alias("URL")).alias("properties")))
    head = F.regexp_replace(props, r"\}\z", "")
    payload = F.when(F.col("batch") == 0, F.concat(head, F.lit(',"children":['), F.col("children"), F.lit("]}"))) \
        .otherwise(F.concat(F.lit('{"children":['), F.col("children"), F.lit("]}")))
    return g.join(v, "video_id", "left").select("video_id", "batch", "n_children", "title", payload.alias("payload"))
