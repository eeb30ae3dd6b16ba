"""The composed channel sync keeps the invariants of its steps."""

from pyspark.sql import functions as F

from captionflow.operators import state as ST
from captionflow.plans.sync import channel_sync
from captionflow.sources import fixtures as X
from captionflow.sources import state_files as SF


def test_channel_sync_invariants(spark, sf_small):
    ev, orders = X.table(spark, sf_small, "events"), X.table(spark, sf_small, "orders")
    history = ST.merge_videos(X.fx_obs_rows(ev))
    listing = X.fx_listing_by_customer(orders)
    state = ST.dedup_state(X.fx_obs_rows(ev)).filter(F.col("channel_id") == "ch1")
    files = SF.describe_files(X.fx_files(X.table(spark, sf_small, "documents")))
    outcomes = X.fx_outcomes(X.fx_obs(ev)).unionByName(
        listing.select("video_id").distinct().select("video_id", F.lit(0).alias("exit_code"),
                                                     F.lit(True).alias("has_caption")))
    outcomes = outcomes.groupBy("video_id").agg(F.min("exit_code").alias("exit_code"),
                                               F.max("has_caption").alias("has_caption"))
    r = channel_sync(history, state, listing, files, outcomes=outcomes, channel_name="up3", playlist="PLX",
                     as_of=X.OUTCOME_AS_OF)
    st = r.state
    ids = {x.video_id for x in st.select("video_id").collect()}
    listed = {x.video_id for x in listing.select("video_id").distinct().collect()}
    stored = {x.video_id for x in state.select("video_id").collect()}
    assert listed | stored <= ids                                  # nothing listed or stored is lost
    assert st.count() == len(ids)                                  # one row per video
    assert r.plan.count() == st.count()                            # no date filter: every video planned
    assert set(x.action for x in r.plan.select("action").distinct().collect()) <= {
        "skip_done", "skip_no_subtitle", "convert", "skip_on_disk", "fetch"}
    s = r.summary.agg(F.sum("total").alias("t"), F.sum("downloaded").alias("d")).collect()[0]
    assert s.t == st.count() and s.d > 0
    # listed videos carry the playlist context
    pl = st.filter(F.array_contains("playlists", "PLX")).select("video_id").collect()
    assert {x.video_id for x in pl} >= listed


def test_regen_markdown_per_file(spark):
    """Every file is a document: two languages of an id, an archive copy, a file
    without an id, names with a space; converted ones are left out."""
    import os
    import tempfile
    from captionflow.plans.sync import regen_markdown
    d = tempfile.mkdtemp(prefix="regen-", dir="/tmp")
    os.makedirs(os.path.join(d, "archive"))
    os.makedirs(os.path.join(d, "deep", "er"))
    names = ("chan-abcdefghijk-pt.srt", "chan-abcdefghijk-en.srt", "archive/chan-abcdefghijk-pt.srt",
             "archive/chan-bcdefghijkl-en.srt", "talk.srt", "my talk.srt", "chan-cdefghijklm-pt.srt", "deep/er/chan-xxxxxxxxxxx-pt.srt")
    for k, name in enumerate(names):
        with open(os.path.join(d, name), "w") as f:
            f.write("".join(f"{i + 1}\n00:00:{i * 10:02d},000 --> 00:00:{i * 10 + 9:02d},000\n"
                            f"word{k}x{i} topic{i % 3} idea{i}.\n\n" for i in range(5)))
    with open(os.path.join(d, "chan-cdefghijklm-pt.md"), "w") as f:     # already converted
        f.write("# done\n")
    state = spark.createDataFrame([("abcdefghijk", 1, "Stored title")], "video_id string, ord long, title string")
    frags = regen_markdown(spark, d, state).collect()
    heads = {r.video_id.split(os.path.basename(d) + "/")[1]: r.fragment for r in frags if r.part == 0}
    assert set(heads) == set(names[:6])
    assert all(heads[n].startswith("## Stored title ") for n in names[:3])
    assert heads[names[3]].startswith("## chan-bcdefghijkl-en ") and heads["my talk.srt"].startswith("## my talk ")
    assert "watch?v=abcdefghijk" in heads[names[1]]
    for k, name in enumerate(names[:6]):
        body = "".join(r.fragment for r in frags if r.video_id.endswith(os.path.basename(d) + "/" + name) and r.part == 5)
        assert f"word{k}x0".lower() in body.lower() and not any(f"word{j}x" in body.lower() for j in range(8) if j != k)


def test_sync_runs_again_from_what_it_wrote(spark):
    """The second sync reads the first's document: what was fetched is done, what was
    closed stays closed, the language stays, nothing is lost."""
    import json
    import os
    import tempfile
    from captionflow.plans.sync import sync_folder
    d = tempfile.mkdtemp(prefix="sync-", dir="/tmp")
    listing = spark.createDataFrame([("vidaaaaaaaa", 1, "A", "20240101", None), ("vidbbbbbbbb", 2, "B", "20240102", None),
                                     ("vidcccccccc", 3, "C", "20240530", None), ("viddddddddd", 4, "D", None, None)],
                                    "video_id string, ord long, title string, upload_date string, epoch_s long")
    history = spark.createDataFrame([("vidaaaaaaaa", 9, "ch", "@u"), ("videeeeeeee", 7, "ch", "@u")], "video_id string, ord long, channel_id string, uploader_id string")
    history = ST.merge_videos(history)
    files = spark.createDataFrame([], "video_id string, path string")
    tags = spark.createDataFrame([("c", 1, "en-US"), ("c", 2, "en"), ("x", 1, "fr")], "channel string, ord long, tag string")
    outcomes = spark.createDataFrame([("vidaaaaaaaa", 0, True), ("vidbbbbbbbb", 0, False), ("vidcccccccc", 0, False), ("viddddddddd", 1, False)],
                                     "video_id string, exit_code int, has_caption boolean")
    first = sync_folder(spark, d, "c", history, listing, files, outcomes=outcomes, as_of="2024-06-01", tags=tags)
    assert {r.video_id: r.action for r in first.plan.collect()} == dict.fromkeys(
        ["vidaaaaaaaa", "vidbbbbbbbb", "vidcccccccc", "viddddddddd", "videeeeeeee"], "fetch")
    name, = os.listdir(d)
    doc = json.load(open(os.path.join(d, name)))
    assert name == f"{SF.STATE_PREFIXES[0]}c.json" and doc["detected_language"] == "en" and doc["channel"] == "@c"
    assert [v["video_id"] for v in doc["videos"]] == ["vidaaaaaaaa", "vidbbbbbbbb", "vidcccccccc", "viddddddddd", "videeeeeeee"]
    new = listing.limit(0).union(spark.createDataFrame([("vidffffffff", 1, "F", "20240601", None)], listing.schema))
    second = sync_folder(spark, d, "c", history, new, files, as_of="2024-06-02")
    assert {r.video_id: r.action for r in second.plan.collect()} == {
        "vidaaaaaaaa": "skip_done", "vidbbbbbbbb": "skip_no_subtitle", "vidcccccccc": "fetch", "viddddddddd": "fetch",
        "videeeeeeee": "fetch", "vidffffffff": "fetch"}
    again = json.load(open(os.path.join(d, name)))
    assert [v["video_id"] for v in again["videos"]][-1] == "vidffffffff" and again["videos"][:5] == doc["videos"]
    assert again["detected_language"] == "en"
