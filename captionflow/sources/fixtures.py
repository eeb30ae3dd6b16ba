"""Stand-in inputs built from the given test tables.

Each function only reshapes rows of a test table into the schema an operator
expects (captions, state observations, listings, file inventories, ...). None of
them does any operator's work; the operators must be right for any data of the
same schema. The DuckDB twins of these definitions live in
:mod:`captionflow.plans.oracle_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage_buckets
from .state_files import STATE_PREFIXES

SENTENCE_RE = r"[^.!?\n]+[.!?]*"
MS_PER_WORD = 2000
OUTCOME_AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fx_cues(documents: DataFrame) -> DataFrame:
    """FX-CUES: one caption cue per sentence of a document.

    ``(video_id, lang, seq, start_ms, end_ms, raw_text)``; every fourth cue repeats
    the previous sentence in front (roll-up), every fourth wraps in ``<i>`` tags.
    """
    s = (documents.select("doc_id", "lang",
                          F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE_RE), 0)).alias("pos", "t"))
         .withColumn("t", F.trim("t")).filter(F.col("t") != "")
         # as many tasks as the input needs, whatever the number of shuffle partitions is
         .repartition(stage_buckets(documents), "doc_id"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    s = (s.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
         .withColumn("nw", F.size(F.split("t", r"\s+")).cast("long"))
         .withColumn("p", F.lag("t").over(w))
         .withColumn("cum", F.sum("nw").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    raw = (F.when(F.col("seq") % 4 == 1, F.concat_ws(" ", "p", "t"))
           .when(F.col("seq") % 4 == 3, F.concat(F.lit("<i>"), "t", F.lit("</i>")))
           .otherwise(F.col("t")))
    return s.select(
        F.concat(F.lit("v"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("video_id"),
        "lang", "seq",
        (F.lit(MS_PER_WORD) * (F.col("cum") - F.col("nw"))).alias("start_ms"),
        (F.lit(MS_PER_WORD) * F.col("cum")).alias("end_ms"),
        raw.alias("raw_text"))


def fx_cue_langs(documents: DataFrame) -> DataFrame:
    """The distinct ``(video_id, lang)`` of FX-CUES, from the documents that have a cue."""
    cues = F.regexp_extract_all("text", F.lit(SENTENCE_RE), 0)
    return documents.filter(F.exists(cues, lambda t: F.trim(t) != "")).select(
        F.concat(F.lit("v"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("video_id"), "lang").distinct()


def fx_videos(documents: DataFrame) -> DataFrame:
    """Per-video header data for Markdown: title = file-stem default, unknown date."""
    return documents.select(
        F.concat(F.lit("v"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("video_id"),
        F.concat(F.lit("chan-v"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("title"),
        F.lit("Desconhecida").alias("publish_date"))


def fx_obs(events: DataFrame) -> DataFrame:
    """FX-OBS: observations of video state from ``events``."""
    k = F.get_json_object("props", "$.k").cast("long")
    et = F.col("event_type")
    return events.select(
        F.concat(F.lit("e"), F.lpad((F.col("user_id") * 20 + k % 20).cast("string"), 10, "0")).alias("video_id"),
        F.col("event_id").alias("ord"),
        F.when(et == "view", F.date_format("ts", "yyyy-MM-dd")).when(et == "error", F.lit(None))
         .otherwise(F.lit("N/A")).alias("publish_date"),
        F.when(et == "click", F.concat(F.lit("T"), F.col("event_id").cast("string")))
         .when(et == "purchase", F.lit("Avulso")).when(et == "signup", F.lit("")).otherwise(F.lit("N/A")).alias("title"),
        ((et == "purchase") & (F.col("value") > 20)).alias("subtitle_downloaded"),
        (et == "view").alias("info_downloaded"),
        ((et == "error") & (F.col("value") > 50)).alias("has_no_subtitle"),
        F.concat(F.lit("PL"), (F.col("event_id") % 7).cast("string")).alias("playlist"),
        F.concat(F.lit("ch"), F.floor(F.col("user_id") / 3).cast("string")).alias("channel_id"),
        F.concat(F.lit("@up"), F.floor(F.col("user_id") / 3).cast("string")).alias("uploader_id"),
        F.concat(F.lit("Uploader up"), F.floor(F.col("user_id") / 3).cast("string")).alias("uploader"),
        F.col("value").alias("duration_s"),
        F.col("user_id").alias("view_count"),
    )


def fx_listing(orders: DataFrame) -> DataFrame:
    """FX-LISTING: listing lines ``(video_id, ord, title, upload_date, epoch_s)``."""
    k = F.col("o_orderkey")
    return orders.select(
        F.concat(F.lit("e"), F.lpad(F.floor(k / 4).cast("string"), 10, "0")).alias("video_id"),
        k.alias("ord"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).alias("upload_date"),
        F.when(k % 3 == 1, F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("epoch_s"),
    )


def fx_files(documents: DataFrame) -> DataFrame:
    """FX-FILES: file inventory ``(path, video_id, mtime_s)``."""
    v = F.concat(F.lit("v"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))
    d = F.col("doc_id")
    a = documents.filter(d % 6 != 0).select(
        F.concat(F.lit("chan-"), v, F.lit("."), F.col("lang"), F.lit(".srt")).alias("path"),
        v.alias("video_id"), (F.lit(1700000000) + d % 97).alias("mtime_s"))
    b = documents.filter(d % 5 == 0).select(
        F.concat(F.lit("chan-"), v, F.lit("."), F.col("lang"), F.lit("-XX.srt")).alias("path"),
        v.alias("video_id"), (F.lit(1700000000) + d % 89).alias("mtime_s"))
    c = documents.filter(d % 7 == 0).select(
        F.concat(F.lit("chan-"), v, F.lit("-"), F.col("lang"), F.lit(".md")).alias("path"),
        v.alias("video_id"), (F.lit(1700000000) + d % 83).alias("mtime_s"))
    return a.unionByName(b).unionByName(c)


def fx_inputs(pages: DataFrame) -> DataFrame:
    """FX-INPUTS: user inputs of every kind ``(page_id, input, url)``."""
    p = F.col("page_id")
    pid10 = F.lpad(p.cast("string"), 10, "0")
    inp = (F.when(p % 5 == 0, F.col("url"))
           .when(p % 5 == 1, F.concat(F.lit("https://www.youtube.com/watch?v=p"), pid10))
           .when(p % 5 == 2, F.concat(F.lit("@ch"), p.cast("string")))
           .when(p % 5 == 3, F.concat(F.lit("playlist?list=PL"), p.cast("string")))
           .otherwise(F.concat(F.lit("p"), pid10)))
    return pages.select("page_id", inp.alias("input"), "url")


def fx_tags(documents: DataFrame) -> DataFrame:
    """FX-TAGS: language tags ``(channel, ord, tag)``."""
    d = F.col("doc_id")
    tag = (F.when(d % 9 == 0, F.lit("NA"))
           .when(d % 9 == 1, F.concat(F.upper("lang"), F.lit("-BR")))
           .when(d % 9 == 2, F.concat(F.col("lang"), F.lit("_XX")))
           .otherwise(F.col("lang")))
    return documents.select(F.col("source").alias("channel"), d.alias("ord"), tag.alias("tag"))


def fx_md(documents: DataFrame) -> DataFrame:
    """FX-MD: Markdown documents with headings, bullets, spans, rules and fences."""
    d = F.col("doc_id")
    md = F.concat_ws(
        "\n",
        F.concat(F.lit("## Doc "), d.cast("string")), F.lit(""),
        F.concat(F.lit("* `code"), d.cast("string"), F.lit("` and **bold "), F.col("lang"), F.lit("**")),
        F.lit("---"), F.col("text"), F.lit("```python"), F.concat(F.lit("x = "), d.cast("string")),
        F.when(d % 11 != 0, F.lit("```")))
    return documents.select(F.concat(F.lit("v"), F.lpad(d.cast("string"), 10, "0")).alias("video_id"), md.alias("md"))


def fx_outcomes(obs: DataFrame) -> DataFrame:
    """FX-OUTCOMES: one fetch outcome per observed video."""
    n = F.regexp_extract("video_id", r"(\d+)$", 1).cast("long")
    return (obs.select("video_id").distinct()
            .select("video_id", F.when(n % 10 == 0, 1).otherwise(0).alias("exit_code"),
                    (n % 3 != 0).alias("has_caption")))


#: Days between the rounds of FX-DATED, and the first round's day.
FETCH_ROUNDS, FETCH_STEP, FETCH_START = 4, 4, "2024-03-05"


def fx_dated_outcomes(obs: DataFrame, j: int) -> DataFrame:
    """FX-DATED: the fetches of round ``j``, with the publish date that the plan knows:
    two thirds of the videos, some failing, a quarter with a caption."""
    n = F.regexp_extract("video_id", r"(\d+)$", 1).cast("long")
    day = F.date_add(F.to_date(F.lit(FETCH_START)), j * FETCH_STEP)
    return (obs.select("video_id").distinct().filter((n * 7 + j) % 3 != 0)
            .select("video_id", F.when(n % 13 == 0, "N/A").when(n % 17 != 0, F.date_format(F.date_add(
                F.to_date(F.lit("2024-02-26")), (n % 18).cast("int")), "yyyy-MM-dd")).alias("publish_date"),
                    F.when((n + j) % 5 == 0, 1).otherwise(0).alias("exit_code"), ((n + j) % 4 == 3).alias("has_caption"),
                    day.cast("timestamp").alias("at")))


def fx_obs_rows(events: DataFrame) -> DataFrame:
    """FX-OBS as state rows: the observation's playlist as a one-element list."""
    o = fx_obs(events)
    return (o.withColumn("playlists", F.array("playlist")).drop("playlist")
            .withColumn("channel", F.lit(None).cast("string")))


def fx_listing_docs(orders: DataFrame) -> DataFrame:
    """FX-JSON listing lines ``(ord, value)``: JSON per listing row; every 50th
    line cut in half, every 51st without ``id``."""
    k = F.col("o_orderkey")
    li = fx_listing(orders)
    full = F.to_json(F.struct(F.when(F.col("ord") % 51 != 0, F.col("video_id")).alias("id"), "title",
                              "upload_date", F.col("epoch_s").alias("timestamp")))
    line = F.when(F.col("ord") % 50 == 0, F.substring(full, 1, (F.length(full) / 2).cast("int"))).otherwise(full)
    return li.select("ord", line.alias("value"))


def fx_state_docs(events: DataFrame) -> DataFrame:
    """FX-JSON state documents: one per channel and block of a thousand ``ord``, odd
    channels as the bare list. ``(path, doc)``; a document lists its rows in ``ord``
    order."""
    o = fx_obs_rows(events)
    n = F.regexp_extract("channel_id", r"(\d+)$", 1).cast("int")
    vid = F.struct(F.when(F.col("ord") % 2 == 0, F.col("video_id")).alias("video_id"),
                   F.when(F.col("ord") % 2 == 1, F.col("video_id")).alias("id"),
                   "publish_date", "title", "subtitle_downloaded", "info_downloaded", "has_no_subtitle",
                   "playlists", "channel_id", "uploader", "uploader_id", "duration_s", "view_count")
    docs = o.groupBy("channel_id", F.floor(F.col("ord") / 1000).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", vid.alias("v")))), lambda x: x["v"]).alias("videos"))
    doc = F.when(n % 2 == 0, F.to_json(F.struct(F.col("channel_id").alias("channel"), "videos"))) \
        .otherwise(F.to_json("videos"))
    return docs.select(F.concat(F.lit(STATE_PREFIXES[0]), F.col("channel_id"), F.lit("-"), F.col("block").cast("string"),
                                 F.lit(".json")).alias("path"),
                       doc.alias("doc"))


def fx_info_docs(events: DataFrame) -> DataFrame:
    """FX-INFO per-video metadata documents ``(name, doc)`` from ``events``."""
    e = F.col("ord")
    o = fx_obs(events).join(events.select(F.col("event_id").alias("ord"), "ts"), "ord")
    m = F.struct(
        F.when(e % 3 == 0, F.date_format("ts", "yyyyMMdd")).when(e % 3 == 2, F.lit("soon")).alias("upload_date"),
        F.when(e % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("publish_date"),
        F.when(e % 4 != 0, F.concat(F.lit("T"), e.cast("string"))).alias("title"),
        F.when(e % 8 == 0, F.concat(F.lit("F"), e.cast("string"))).alias("fulltitle"),
        F.when(e % 2 == 0, F.col("channel_id")).alias("channel_id"),
        F.when(e % 6 != 1, F.col("uploader_id")).alias("uploader_id"),
        F.when(e % 3 != 1, F.col("uploader")).alias("uploader"),
        F.concat(F.lit("Channel "), F.col("channel_id")).alias("channel"),
        (e % 9 == 0).alias("subtitle_downloaded"))
    doc = F.when(e % 13 == 0, F.lit("[1, 2]")).otherwise(F.to_json(m))
    return o.select(F.col("ord").alias("ord"),
                    F.concat(F.lit("chan-"), F.col("video_id"), F.lit(".info.json")).alias("name"), doc.alias("doc"))


LOG_FILES = ("historico.txt", "historico-info.txt", "videos_sem_legenda.txt")


def fx_log_lines(events: DataFrame) -> DataFrame:
    """FX-LOGS ``(file, value)``: id logs from FX-OBS flags plus noise lines."""
    o = fx_obs(events)
    a = o.filter("subtitle_downloaded").select(F.lit(LOG_FILES[0]).alias("file"),
                                               F.concat(F.lit("youtube "), "video_id").alias("value"))
    b = o.filter("info_downloaded").select(F.lit(LOG_FILES[1]).alias("file"),
                                           F.concat(F.lit("  youtube "), "video_id", F.lit("  ")).alias("value"))
    c = o.filter("has_no_subtitle").select(F.lit(LOG_FILES[2]).alias("file"),
                                           F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("value"))
    noise = o.filter(F.col("ord") % 17 == 0).select(
        F.element_at(F.array(*[F.lit(x) for x in LOG_FILES]), (F.col("ord") % 3 + 1).cast("int")).alias("file"),
        F.concat(F.lit("# note "), F.col("ord").cast("string")).alias("value"))
    return a.unionByName(b).unionByName(c).unionByName(noise)


def fx_json_files(documents: DataFrame) -> DataFrame:
    """FX-JSONFILES: JSON file inventory ``(path, mtime_s)``, fifty files to a folder."""
    d = F.col("doc_id")
    v = F.concat(F.lit("v"), F.lpad(d.cast("string"), 10, "0"))
    folder = F.concat(F.lit("d"), F.floor(d / 50).cast("string"))
    name = (F.when(d % 97 == 0, F.lit("package.json"))
            .when(d % 10 == 0, F.concat(F.lit(STATE_PREFIXES[0]), F.col("source"), F.lit(".json")))
            .when(d % 10 == 1, F.concat(F.lit(STATE_PREFIXES[1]), F.col("source"), F.lit(".json")))
            .when(d % 10 <= 5, F.concat(F.lit("chan-"), v, F.lit(".info.json")))
            .otherwise(F.concat(F.lit("notes"), (d % 10).cast("string"), F.lit(".json"))))
    return documents.select(F.concat(folder, F.lit("/"), name).alias("path"),
                            (F.lit(1700000000) + (d * 37) % 1009).alias("mtime_s"))


def fx_listing_by_customer(orders: DataFrame) -> DataFrame:
    """FX-LISTING-C: a second channel listing keyed by customer, so the history
    holds videos this listing lacks (reverse-import candidates)."""
    k = F.col("o_orderkey")
    return orders.select(
        F.concat(F.lit("e"), F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("video_id"),
        k.alias("ord"),
        F.col("o_orderpriority").alias("title"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("upload_date"),
        F.lit(None).cast("long").alias("epoch_s"))


def fx_vstate(documents: DataFrame) -> DataFrame:
    """FX-VSTATE: state rows for the caption videos (ids of FX-FILES)."""
    d = F.col("doc_id")
    date = (F.when(d % 4 == 0, F.lit("N/A")).when(d % 4 == 1, F.lit("2024-01-28"))
            .when(d % 4 == 2, F.lit("2023-12-01")).otherwise(F.lit("bad-date")))
    return documents.select(
        F.concat(F.lit("v"), F.lpad(d.cast("string"), 10, "0")).alias("video_id"), d.alias("ord"),
        date.alias("publish_date"), F.concat(F.lit("Doc "), d.cast("string")).alias("title"),
        (d % 4 == 0).alias("subtitle_downloaded"), F.lit(False).alias("info_downloaded"),
        (d % 9 == 0).alias("has_no_subtitle"), F.col("source").alias("channel_id"))


def fx_voutcomes(documents: DataFrame) -> DataFrame:
    """Fetch outcomes for the caption videos."""
    d = F.col("doc_id")
    return documents.select(F.concat(F.lit("v"), F.lpad(d.cast("string"), 10, "0")).alias("video_id"),
                            F.when(d % 10 == 0, 1).otherwise(0).alias("exit_code"), (d % 3 != 0).alias("has_caption"))


def fx_regen_files(documents: DataFrame) -> DataFrame:
    """FX-FILES placed in the working folder or, by mtime parity, ``archive/``."""
    f = fx_files(documents)
    return f.withColumn("path", F.when(F.col("mtime_s") % 2 == 0, F.concat(F.lit("archive/"), "path"))
                        .otherwise(F.col("path")))


def fx_host_lines(pages: DataFrame) -> DataFrame:
    """FX-HOSTS tab-separated host records from page URLs, with comments and short rows."""
    p = F.col("page_id")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    full = F.concat_ws("\t", host, F.lit("TRUE"), F.lit("/"), F.lit("FALSE"), (p * 1000).cast("string"),
                       F.concat(F.lit("k"), p.cast("string")), F.lit("v"))
    short = F.concat_ws("\t", host, F.lit("TRUE"), F.lit("/"))
    line = (F.when(p % 7 == 0, F.concat(F.lit("# page "), p.cast("string"))).when(p % 11 == 0, F.lit(""))
            .when(p % 5 == 0, short).otherwise(full))
    return pages.select("page_id", line.alias("value"))


def fx_state_paths(files: DataFrame) -> DataFrame:
    """``channel`` field of each state document, present for even path lengths."""
    return files.select("path", F.when(F.length("path") % 2 == 0, F.concat(F.lit("@doc"), F.length("path")
                                                                         .cast("string"))).alias("channel"))


def fx_listing_files(orders: DataFrame) -> DataFrame:
    """FX-LISTING-FILES: caption and Markdown files ``(path, mtime_s)`` of some videos
    of FX-LISTING."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("chan-e"), F.lpad(F.floor(k / 4).cast("string"), 10, "0"))

    def of(every, ext):
        return orders.filter(k % every == 0).select(F.concat(name, F.lit(ext)).alias("path"),
                                                    (F.lit(1700000000) + k % 97).alias("mtime_s"))
    return of(12, ".srt").unionByName(of(20, ".md"))


def fx_regen_folder(documents: DataFrame) -> DataFrame:
    """FX-REGEN: FX-FILES in the working folder or ``archive/``, every fifth caption
    file (by mtime) with a Markdown file next to it. ``(path, video_id, mtime_s, uri)``."""
    f = fx_regen_files(documents)
    md = f.filter((F.col("mtime_s") % 5 == 0) & F.col("path").endswith(".srt")) \
        .withColumn("path", F.regexp_replace("path", r"\.srt$", ".md"))
    return f.unionByName(md).withColumn("uri", F.concat(F.lit("file:///"), "path"))


def fx_title_state(documents: DataFrame) -> DataFrame:
    """FX-VSTATE with some empty titles, and half of the rows of other videos."""
    return (fx_vstate(documents)
            .withColumn("video_id", F.when(F.col("ord") % 2 == 0, F.col("video_id"))
                        .otherwise(F.concat(F.lit("x"), F.substring("video_id", 2, 100))))
            .withColumn("title", F.when(F.col("ord") % 5 == 0, F.lit("")).otherwise(F.col("title"))))
