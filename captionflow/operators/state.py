"""Corpus state: merging repeated observations of a video, listings, history,
legacy logs, metadata, and the per-video work plan.

Every "first valid value wins" rule is an order-free aggregate over an explicit
order column (``min_by(value, ord)`` with a filter), so map-side partial
aggregation applies and a video observed millions of times costs one partial
row per map task. Joins are equi-joins; Spark/AQE picks the physical strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

FLAGS = ("subtitle_downloaded", "info_downloaded", "has_no_subtitle")
EXTRA = ("channel_id", "uploader", "uploader_id", "duration_s", "channel", "view_count")
STATE_COLS = ("video_id", "publish_date", "title") + FLAGS
EXTRA_TYPES = {"channel_id": "string", "uploader": "string", "uploader_id": "string", "duration_s": "double",
               "channel": "string", "view_count": "long"}


def _first_strong(col: str, weak: Column, ord_col: str) -> Column:
    """First non-weak value in order, else the first row's value."""
    return F.coalesce(F.min_by(F.when(~weak, F.col(col)), F.when(~weak, F.col(ord_col))),
                      F.min_by(F.col(col), F.col(ord_col)))


def conform(rows: DataFrame) -> DataFrame:
    """Add any missing state column as null/false so sources can be unioned; a flag that
    is null counts as false."""
    out = with_flags(rows)
    for c in ("publish_date", "title"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    for c, t in EXTRA_TYPES.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    if "playlists" not in out.columns:
        out = out.withColumn("playlists", F.lit(None).cast("array<string>"))
    return out


def with_flags(rows: DataFrame) -> DataFrame:
    """``rows`` with all flags, none of them null."""
    return rows.withColumns({f: F.coalesce(F.col(f).cast("boolean"), F.lit(False)) if f in rows.columns else F.lit(False) for f in FLAGS})


def first_rows(rows: DataFrame, key: str = "video_id", ord_col: str = "ord") -> DataFrame:
    """One row for each key, the first in order; without an order column the least by
    its values. A side that is joined by key must not multiply the other's rows."""
    others = [c for c in rows.columns if c != key]
    whole = F.struct(*others)
    first = F.min_by(whole, F.struct(ord_col, *[c for c in others if c != ord_col])) if ord_col in others else F.min(whole)
    return rows.groupBy(key).agg(first.alias("_first")).select(key, *[F.col("_first")[c].alias(c) for c in others])


def merge_videos(rows: DataFrame, ord_col: str = "ord", with_playlists: bool = False,
                 extra_aggs: tuple = ()) -> DataFrame:
    """One row per ``video_id``: date/title = first non-weak in ``ord`` order
    (else the first row's value); flags = OR; other columns = first row's value.

    ``with_playlists`` (``dedup_state``) adds the ordered distinct union of all
    ``playlists`` arrays, computed as a (video, playlist) aggregate so no
    video's observations are gathered into one list; otherwise the first row's
    list is kept. ``ord_col`` may be of any orderable type, for example a struct
    of source and position (:func:`in_source_order`). ``extra_aggs`` are more
    aggregate columns computed in the same pass.
    """
    rows = conform(rows)
    agg = [
        _first_strong("publish_date", S.is_weak_date("publish_date"), ord_col).alias("publish_date"),
        _first_strong("title", S.is_weak_title("title"), ord_col).alias("title"),
        *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in FLAGS],
        *[F.min_by(c, ord_col).alias(c) for c in EXTRA],
        F.min(ord_col).alias(ord_col),
        *extra_aggs,
    ]
    if with_playlists:
        agg.append(F.bool_or(F.col("playlists").isNotNull()).alias("_has"))
    else:
        agg.append(F.min_by("playlists", ord_col).alias("playlists"))
    merged = rows.groupBy("video_id").agg(*agg)
    if not with_playlists:
        return merged
    pl = (rows.select("video_id", ord_col, F.posexplode("playlists").alias("pos", "playlist"))
          .groupBy("video_id", "playlist").agg(F.min(F.struct(ord_col, "pos")).alias("first")))
    # bounded by the number of distinct playlists of one video
    lists = pl.groupBy("video_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "playlist"))), lambda x: x["playlist"])
        .alias("playlists"))
    return (merged.join(lists, "video_id", "left")
            .withColumn("playlists", F.when(F.col("_has"), F.coalesce("playlists", F.array().cast("array<string>"))))
            .drop("_has"))


def dedup_state(rows: DataFrame, ord_col: str = "ord", extra_aggs: tuple = ()) -> DataFrame:
    """The merge applied before a state snapshot is written (adds playlists)."""
    return merge_videos(rows, ord_col, with_playlists=True, extra_aggs=extra_aggs)


def in_source_order(*sources: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Union of sources whose order key becomes ``(src, ord)``: the index of the
    source leads, then the source's own order, whatever its range or type."""
    u = None
    for i, s in enumerate(sources):
        p = conform(s).withColumn(ord_col, F.struct(F.lit(i).alias("src"), F.col(ord_col).alias("ord")))
        u = p if u is None else u.unionByName(p, allowMissingColumns=True)
    return u


def union_history(*sources: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Union of state-file rows and metadata rows (in the given source order),
    merged by id. ``ord`` of the result is the order key ``(src, ord)``."""
    return merge_videos(in_source_order(*sources, ord_col=ord_col), ord_col)


def listing_rows(listing: DataFrame) -> DataFrame:
    """Listing lines -> new state rows: title fallback ``N/A``, date from
    ``upload_date`` or the Unix time, all flags false."""
    fulltitle = F.col("fulltitle") if "fulltitle" in listing.columns else F.lit(None).cast("string")
    epoch = F.col("epoch_s") if "epoch_s" in listing.columns else None
    return listing.select(
        "video_id", "ord",
        S.normalize_date(F.col("upload_date"), epoch).alias("publish_date"),
        S.coalesce_title("title", fulltitle, default="N/A").alias("title"),
        *[F.lit(False).alias(f) for f in FLAGS])


def fill_dates(listing: DataFrame, history: DataFrame) -> DataFrame:
    """Unknown listing dates take the history's valid date (titles do not). Of repeated
    history ids the first row with a valid date counts (by ``ord``, if there is one)."""
    valid = history.filter(~S.is_weak_date("publish_date")).select("video_id", F.col("publish_date").alias("_hd"),
                                                                   *(["ord"] if "ord" in history.columns else []))
    h = first_rows(valid).select("video_id", "_hd")
    return (listing.join(h, "video_id", "left")
            .withColumn("publish_date", F.when((F.col("publish_date") == "N/A") & ~S.is_weak_date("_hd"), F.col("_hd"))
                        .otherwise(F.col("publish_date")))
            .drop("_hd"))


def upsert_listing(state: DataFrame, listing: DataFrame, playlist: str | None = None,
                   ord_col: str = "ord") -> DataFrame:
    """Stored rows + listing: the stored value wins unless weak; flags kept;
    the playlist context appended once; unseen ids inserted. Result carries
    ``src`` = ``state`` or ``listed`` for :func:`sync_counts`."""
    st = conform(state).withColumn("_src", F.lit(0))
    ls = conform(listing).withColumn("_src", F.lit(1))
    if playlist is not None:
        ls = ls.withColumn("playlists", F.array(F.lit(playlist)))
    merged = dedup_state(in_source_order(st, ls.select(*st.columns), ord_col=ord_col), ord_col,
                         extra_aggs=(F.min("_src").alias("_s"),))
    return merged.withColumn("src", F.when(F.col("_s") == 0, "state").otherwise("listed")).drop("_s")


def target_channel(listing: DataFrame, history: DataFrame) -> DataFrame:
    """``(channel_id, uploader_id)`` of the first listed video, if history knows it."""
    first = listing.agg(F.min_by("video_id", "ord").alias("video_id"))
    return first.join(history.select("video_id", "channel_id", "uploader_id"), "video_id")


def reverse_import(state: DataFrame, history: DataFrame, target: DataFrame,
                   channel_name: str | None = None) -> DataFrame:
    """History rows absent from the state that belong to the target channel:
    same ``channel_id``, else same ``uploader_id``, else the channel name inside
    the lowercase ``uploader``. ``target`` rows may repeat: its distinct keys are
    probed with equi-joins (the planner broadcasts them when they are few)."""
    t = target.select(F.col("channel_id").alias("_tc"), F.col("uploader_id").alias("_tu"))
    missing = history.join(state.select("video_id"), "video_id", "left_anti")
    by_ch = t.select("_tc").filter(F.col("_tc").isNotNull() & (F.col("_tc") != "")).distinct()
    by_up = t.select("_tu").filter(F.col("_tu").isNotNull() & (F.col("_tu") != "")).distinct()
    j = (missing.join(by_ch, missing["channel_id"] == by_ch["_tc"], "left")
         .join(by_up, missing["uploader_id"] == by_up["_tu"], "left"))
    name = channel_name.lower() if channel_name else None
    cond = F.col("_tc").isNotNull() | F.col("_tu").isNotNull()
    if name:
        cond = cond | F.lower(F.coalesce("uploader", F.lit(""))).contains(name)
    return j.filter(cond).drop("_tc", "_tu")


def apply_legacy_flags(state: DataFrame, logs: DataFrame) -> DataFrame:
    """Three id sets (``kind`` in subtitle, info, no_subtitle) each set one flag;
    ``flips`` counts the flags that changed for the row."""
    sets = logs.groupBy("video_id").agg(
        F.bool_or(F.col("kind") == "subtitle").alias("_s"), F.bool_or(F.col("kind") == "info").alias("_i"),
        F.bool_or(F.col("kind") == "no_subtitle").alias("_n"))
    j = with_flags(state).join(sets, "video_id", "left")
    flips = sum((F.coalesce(F.col(k), F.lit(False)) & ~F.col(f)).cast("int")
                for k, f in (("_s", "subtitle_downloaded"), ("_i", "info_downloaded"), ("_n", "has_no_subtitle")))
    return (j.withColumn("flips", flips)
            .withColumn("subtitle_downloaded", F.col("subtitle_downloaded") | F.coalesce("_s", F.lit(False)))
            .withColumn("info_downloaded", F.col("info_downloaded") | F.coalesce("_i", F.lit(False)))
            .withColumn("has_no_subtitle", F.col("has_no_subtitle") | F.coalesce("_n", F.lit(False)))
            .drop("_s", "_i", "_n"))


def harvest_metadata(state: DataFrame, info: DataFrame) -> DataFrame:
    """Matched rows: weak title/date and empty duration, channel, view count take
    the metadata's values; ``info_downloaded`` set. Of repeated metadata rows of an id the
    first counts (by ``ord``, if there is one)."""
    i = first_rows(info).select("video_id", F.col("title").alias("_t"), F.col("upload_date").alias("_d"),
                    F.col("duration").alias("_dur"), F.coalesce(F.nullif("channel", F.lit("")), "uploader").alias("_ch"),
                    F.col("view_count").alias("_vc"), F.lit(True).alias("_m"))
    j = conform(state).join(i, "video_id", "left")
    m = F.col("_m").isNotNull()
    new_date = F.when((F.length("_d") == 8), S.normalize_date("_d"))
    return (j.withColumn("title", F.when(m & S.is_weak_title("title"), F.coalesce(F.nullif("_t", F.lit("")), "title"))
                         .otherwise(F.col("title")))
            .withColumn("publish_date", F.when(m & S.is_weak_date("publish_date") & new_date.isNotNull(), new_date)
                        .otherwise(F.col("publish_date")))
            .withColumn("duration_s", F.when(m & (F.col("duration_s").isNull() | (F.col("duration_s") == 0)), F.col("_dur"))
                        .otherwise(F.col("duration_s")))
            .withColumn("channel", F.when(m & (F.col("channel").isNull() | (F.col("channel") == "")), F.col("_ch"))
                        .otherwise(F.col("channel")))
            .withColumn("view_count", F.when(m & (F.col("view_count").isNull() | (F.col("view_count") == 0)), F.col("_vc"))
                        .otherwise(F.col("view_count")))
            .withColumn("info_downloaded", F.col("info_downloaded") | m)
            .drop("_t", "_d", "_dur", "_ch", "_vc", "_m"))


def heal_metadata(state: DataFrame, recovered: DataFrame) -> DataFrame:
    """Second-source fallback only where title or date is exactly ``N/A``. Of repeated rows
    of an id the first counts (by ``ord``, if there is one)."""
    state = with_flags(state)
    r = first_rows(recovered).select("video_id", F.col("title").alias("_t"), F.col("date").alias("_d"))
    j = state.join(r, "video_id", "left")
    t_fix = (F.coalesce("title", F.lit("N/A")) == "N/A") & F.col("_t").isNotNull() & (F.col("_t") != "N/A")
    d_fix = (F.coalesce("publish_date", F.lit("N/A")) == "N/A") & F.col("_d").isNotNull() & (F.col("_d") != "N/A")
    return (j.withColumn("healed", t_fix | d_fix)
            .withColumn("title", F.when(t_fix, F.col("_t")).otherwise(F.col("title")))
            .withColumn("publish_date", F.when(d_fix, F.col("_d")).otherwise(F.col("publish_date")))
            .withColumn("info_downloaded", F.col("info_downloaded") | F.col("healed"))
            .drop("_t", "_d"))


def focus_video(state: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows for the requested ids; an id not in the state gets a default row."""
    j = ids.select("video_id").distinct().join(state.withColumn("_stored", F.lit(True)), "video_id", "left")
    found = F.col("_stored").isNotNull()
    return j.select(
        "video_id",
        F.when(found, F.col("publish_date")).otherwise(F.lit("N/A")).alias("publish_date"),
        F.when(found, F.col("title")).otherwise(F.lit("Avulso")).alias("title"),
        *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in FLAGS],
        (~found).alias("injected"))


def filter_since(state: DataFrame, since: str | None = None) -> DataFrame:
    """Rows published on or after ``since`` (``YYYYMMDD``); no filter = identity."""
    if not since:
        return state
    d = F.col("publish_date")
    return state.filter(d.isNotNull() & (d != "") & (d != "N/A") & (F.replace(d, F.lit("-"), F.lit("")) >= F.lit(since)))


def files_present(files: DataFrame) -> DataFrame:
    """``(video_id, has_srt, has_md)`` from a file inventory with ``video_id``."""
    name = F.col("path")
    return files.groupBy("video_id").agg(F.bool_or(name.endswith(".srt")).alias("has_srt"),
                                         F.bool_or(name.endswith(".md")).alias("has_md"))


def plan_work(state: DataFrame, present: DataFrame, audio_only: bool = False, convert: bool = True) -> DataFrame:
    """One action per video, first match wins: ``skip_done``, ``skip_no_subtitle``
    (both only outside audio-only mode), ``convert`` (caption file without
    Markdown), ``skip_on_disk``, ``fetch``. On-disk actions also set both flags. A null
    flag counts as false."""
    j = with_flags(state).join(present, "video_id", "left")
    srt, md = F.coalesce("has_srt", F.lit(False)), F.coalesce("has_md", F.lit(False))
    ao = F.lit(audio_only)
    action = (F.when(F.col("subtitle_downloaded") & ~ao, "skip_done")
              .when(F.col("has_no_subtitle") & ~ao, "skip_no_subtitle")
              .when(srt & ~md & F.lit(convert), "convert")
              .when(srt | md, "skip_on_disk")
              .otherwise("fetch"))
    on_disk = action.isin("convert", "skip_on_disk")
    return (j.withColumn("action", action)
            .withColumn("info_downloaded", F.col("info_downloaded") | on_disk)
            .withColumn("subtitle_downloaded", F.col("subtitle_downloaded") | on_disk)
            .drop("has_srt", "has_md"))


def apply_outcomes(plan: DataFrame, outcomes: DataFrame, as_of: str, audio_only: bool = False) -> DataFrame:
    """Fetch outcomes -> new flags and a counter class per video.

    Exit code 0 with a caption -> ``downloaded`` and the caption flag (audio-only
    success counts as downloaded, no flag); 0 without caption (false or null) ->
    ``skipped``, and ``has_no_subtitle`` if older than 7 days; nonzero -> ``error``. Rows
    not fetched are ``skipped``; a null flag counts as false."""
    # of repeated outcomes of a video the best counts: a caption, then success, then the least code
    best = outcomes.groupBy("video_id").agg(F.min_by(F.struct("exit_code", "has_caption"), F.struct(
        F.coalesce(F.col("exit_code") != 0, F.lit(True)), ~F.coalesce("has_caption", F.lit(False)), "exit_code")).alias("_o"))
    j = with_flags(plan).join(best.select("video_id", "_o.exit_code", F.coalesce("_o.has_caption", F.lit(False)).alias("has_caption")),
                              "video_id", "left")
    fetched = (F.col("action") == "fetch") & F.col("exit_code").isNotNull()
    ok = fetched & (F.col("exit_code") == 0)
    got = ok & (F.lit(audio_only) | F.col("has_caption"))
    none = ok & ~F.lit(audio_only) & ~F.col("has_caption")
    cls = (F.when(F.col("action") != "fetch", "skipped").when(F.col("exit_code").isNull(), "pending")
           .when(got, "downloaded").when(none, "skipped").otherwise("error"))
    mature = S.maturity_gate("publish_date", F.to_date(F.lit(as_of)))
    return (j.withColumn("outcome", cls)
            .withColumn("subtitle_downloaded", F.col("subtitle_downloaded") | (got & ~F.lit(audio_only)))
            .withColumn("has_no_subtitle", F.col("has_no_subtitle") | (none & mature))
            .drop("exit_code", "has_caption"))


def session_summary(outcomes: DataFrame, by: str = "channel_id") -> DataFrame:
    return outcomes.groupBy(by).agg(
        F.count_if(F.col("outcome") == "downloaded").alias("downloaded"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "error").alias("error"),
        F.count(F.lit(1)).alias("total"))


def sync_counts(rows: DataFrame, by: str = "channel_id") -> DataFrame:
    """What a sync did to each channel, from rows tagged ``src`` (state, listed or
    imported) with their legacy ``flips``. Rows without a channel count under ''."""
    return rows.groupBy(F.coalesce(by, F.lit("")).alias(by)).agg(
        F.count_if(F.col("src") == "state").alias("from_state"),
        F.count_if(F.col("src") == "listed").alias("newly_listed"),
        F.count_if(F.col("src") == "imported").alias("imported"),
        F.coalesce(F.sum("flips"), F.lit(0)).cast("long").alias("legacy_flips"))


def state_summary(state: DataFrame, by: str = "channel_id") -> DataFrame:
    return state.groupBy(by).agg(F.count_if("info_downloaded").alias("info_downloaded"),
                                 F.count_if("has_no_subtitle").alias("has_no_subtitle"),
                                 F.count(F.lit(1)).alias("total"))


def date_coverage(rows: DataFrame, by: str | None = None) -> DataFrame:
    known = ~S.is_weak_date("publish_date")
    g = rows.groupBy(by) if by else rows.groupBy()
    return g.agg(F.count_if(known).alias("with_date"), F.count(F.lit(1)).alias("total"))


def playlist_owner(history: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Per playlist: owner key of the first history row listing it with an uploader."""
    rows = (history.filter(F.col("uploader_id").isNotNull() & (F.col("uploader_id") != ""))
            .select(ord_col, "uploader_id", F.explode("playlists").alias("playlist")))
    return rows.groupBy("playlist").agg(F.regexp_replace(F.min_by("uploader_id", ord_col), "^@+", "").alias("owner"))


def detect_language(tags: DataFrame, sample: int = 5, default: str = "pt") -> DataFrame:
    """Per channel: mode of the first ``sample`` tags (lowercased, invalid ones
    dropped after sampling); ties go to the tag seen first; the winner is cut at
    ``-``/``_``. Channels with no valid tag get ``default``."""
    t = tags.select("channel", "ord", F.lower(F.trim("tag")).alias("tag")).filter(F.col("tag") != "")
    w = Window.partitionBy("channel").orderBy("ord")
    smp = t.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= sample)
    valid = smp.filter(~F.col("tag").isin(*S.INVALID_LANG_TAGS))
    votes = valid.groupBy("channel", "tag").agg(F.count(F.lit(1)).alias("votes"), F.min("rk").alias("first"))
    n = valid.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("channel").agg(F.min_by(F.struct("tag", "votes"), F.struct(-F.col("votes"), F.col("first")))
                                        .alias("b"))
    chans = tags.select("channel").distinct()
    return (chans.join(best, "channel", "left").join(n, "channel", "left")
            .select("channel",
                    F.coalesce(F.split(F.split(F.col("b.tag"), "-", 2)[0], "_", 2)[0], F.lit(default)).alias("lang"),
                    F.coalesce(F.col("b.votes"), F.lit(0)).alias("votes"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def resolve_language(channels: DataFrame, detected: DataFrame, override: str | None = None,
                     default: str = "pt") -> DataFrame:
    """User override, else the stored language unless ``N/A``, else detected,
    else the default cut to two letters."""
    j = channels.join(detected.select("channel", F.col("lang").alias("_det")), "channel", "left")
    stored = F.when(F.col("stored_lang") != "N/A", S.parse_lang_regex("stored_lang"))
    return j.select("channel", F.coalesce(F.lit(override).cast("string"), stored, F.col("_det"),
                                          F.lit(default[:2].lower())).alias("lang"))


# ---------------------------------------------------------------------------
# Partial merge states: the same first-valid-wins merge as an associative
# combine, so a stored snapshot can be merged with new observations in any
# batch order and give exactly the result of one merge over all rows.
# ---------------------------------------------------------------------------
PARTIAL_EXTRA = EXTRA


def to_partial(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Observation rows -> partial states (one per row); the order key may be of any
    orderable type."""
    r = conform(rows)
    o = F.col(ord_col)
    sd = ~S.is_weak_date("publish_date")
    st = ~S.is_weak_title("title")
    keys = F.transform(F.coalesce("playlists", F.array().cast("array<string>")),
                       lambda x, i: F.struct(F.struct(o.alias("o"), i.cast("long").alias("p")).alias("k"),
                                             x.alias("playlist")))
    return r.select(
        "video_id", o.alias("ord"), F.col("publish_date").alias("date0"), F.col("title").alias("title0"),
        F.when(sd, F.col("publish_date")).alias("sd"), F.when(sd, o).alias("sd_ord"),
        F.when(st, F.col("title")).alias("st"), F.when(st, o).alias("st_ord"),
        *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in FLAGS],
        *[F.col(c) for c in PARTIAL_EXTRA],
        F.col("playlists").isNotNull().alias("has_pl"), keys.alias("pl_keys"))


def combine_partials(parts: DataFrame) -> DataFrame:
    """Merge partial states by id (associative and commutative)."""
    g = parts.groupBy("video_id").agg(
        F.min("ord").alias("ord"), F.min_by("date0", "ord").alias("date0"), F.min_by("title0", "ord").alias("title0"),
        F.min_by("sd", "sd_ord").alias("sd"), F.min("sd_ord").alias("sd_ord"),
        F.min_by("st", "st_ord").alias("st"), F.min("st_ord").alias("st_ord"),
        *[F.bool_or(f).alias(f) for f in FLAGS],
        *[F.min_by(c, "ord").alias(c) for c in PARTIAL_EXTRA],
        F.bool_or("has_pl").alias("has_pl"))
    kp = (parts.select("video_id", F.explode("pl_keys").alias("x"))
          .groupBy("video_id", F.col("x.playlist").alias("playlist")).agg(F.min("x.k").alias("k"))
          .groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("k", "playlist"))).alias("pl_keys")))
    return (g.join(kp, "video_id", "left")
            .withColumn("pl_keys", F.coalesce("pl_keys", F.array().cast(kp.schema["pl_keys"].dataType))))


def finalize_partial(parts: DataFrame) -> DataFrame:
    """Partial states -> state rows (the columns of :func:`dedup_state`)."""
    return parts.select(
        "video_id", F.coalesce("sd", "date0").alias("publish_date"), F.coalesce("st", "title0").alias("title"),
        *FLAGS, *PARTIAL_EXTRA, "ord",
        F.when(F.col("has_pl"), F.transform(F.array_sort("pl_keys"), lambda x: x["playlist"])).alias("playlists"))
