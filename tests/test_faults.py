"""Cases outside the fixtures that once gave wrong results."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from captionflow.operators import files as FL
from captionflow.operators import state as ST
from captionflow.sources import sinks, state_files as SF
from captionflow.streaming import sync as SS


def folder(name):
    return tempfile.mkdtemp(prefix=f"{name}-", dir="/tmp")


def test_order_keys_of_any_size(spark):
    big = 1_700_000_000_000
    state = spark.createDataFrame([("a", big, "Stored"), ("b", 5 * big, "N/A")], "video_id string, ord long, title string")
    listed = spark.createDataFrame([("a", 1, "Listed"), ("b", 2, "Listed b"), ("c", 3, "New")], "video_id string, ord long, title string")
    got = {r.video_id: (r.title, r.src) for r in ST.upsert_listing(state, listed).collect()}
    assert got == {"a": ("Stored", "state"), "b": ("Listed b", "state"), "c": ("New", "listed")}
    assert {r.video_id: r.title for r in ST.union_history(state, listed).collect()} == {"a": "Stored", "b": "Listed b", "c": "New"}


def test_history_keeps_the_first_rows_playlists(spark):
    rows = spark.createDataFrame([("a", 2, ["q"]), ("a", 1, ["p", "r"])], "video_id string, ord long, playlists array<string>")
    assert ST.merge_videos(rows).first().playlists == ["p", "r"]


def test_reverse_import_repeated_target(spark):
    hist = ST.conform(spark.createDataFrame([("v", "c1", "u1")], "video_id string, channel_id string, uploader_id string"))
    target = spark.createDataFrame([("c1", "u1"), ("c1", "u1"), ("c1", "u2")], "channel_id string, uploader_id string")
    none = spark.createDataFrame([], "video_id string")
    assert ST.reverse_import(none, hist, target).count() == 1


def test_focus_on_a_stored_row_of_nulls(spark):
    state = spark.createDataFrame([("v", None, None, None, None, None)], "video_id string, publish_date string, title string, "
                                  "subtitle_downloaded boolean, info_downloaded boolean, has_no_subtitle boolean")
    got = {r.video_id: (r.title, r.injected) for r in ST.focus_video(state, spark.createDataFrame([("v",), ("w",)], "video_id string")).collect()}
    assert got == {"v": (None, False), "w": ("Avulso", True)}


def test_variant_folder_with_a_quote(spark):
    files = spark.createDataFrame([("d/d'or-abcdefghijk.pt.srt", "d'or-abcdefghijk.pt.srt", "abcdefghijk")], "path string, name string, video_id string")
    assert FL.pick_caption_variant(files, "d'or").first().new_name == "d'or-abcdefghijk-pt.srt"


def test_malformed_metadata_gives_no_row(spark):
    docs = spark.createDataFrame([('{"title": "T", "upload_date": "2024', "c-abcdefghijk.json"), ('{"title": "T"}', "c-bcdefghijkl.json"),
                                  ("[1]", "c-cdefghijklm.json")], "doc string, name string")
    assert [r.video_id for r in SF.parse_video_info(docs).collect()] == ["bcdefghijkl"]


def test_listing_order_is_unique_over_files(spark):
    d = folder("listings")
    for n in ("a", "b"):
        with open(os.path.join(d, f"{n}.jsonl"), "w") as f:
            f.write(json.dumps({"id": f"id{n}"}) + "\n")
    assert SF.read_listing(spark, d).select("ord").distinct().count() == 2


SCHEMA_MD = "lang string, video_id string, part int, seg long, para int, fragment string"


def test_second_markdown_write_keeps_the_first(spark):
    """One file a document: those that are not written again stay, ids are strings."""
    out = os.path.join(folder("markdown"), "md")
    for vid, text in (("00000000001", "one\n"), ("b", "two\n"), ("b", "three\n")):
        sinks.write_markdown_files(spark.createDataFrame([("pt", vid, 1, 0, 0, "x\n"), ("pt", vid, 0, 0, 0, text)], SCHEMA_MD), out)
    got = {n: open(os.path.join(out, n), encoding="utf-8").read() for n in os.listdir(out)}
    assert got == {"00000000001.md": "one\nx\n", "b.md": "three\nx\n"}


def test_markdown_packs_follow_the_bytes(spark):
    """The number of files follows the bytes, a document stays together, the index finds it."""
    rows = [(lang, f"v{k:04d}", 0, 0, j, "é" * (50 + k % 7)) for lang, n in (("pt", 300), ("en", 3)) for k in range(n) for j in range(3)]
    rows += [(None, "big", 0, 0, j, "x" * 5_000) for j in range(4)]
    df = spark.createDataFrame(rows, SCHEMA_MD)
    n_files = {}
    for size in (4_000, 40_000):
        out = os.path.join(folder("packs"), "md")
        sinks.write_markdown(df.repartition(5), out, pack_bytes=size)
        files = [os.path.join(d, f) for d, _, names in os.walk(os.path.join(out, "packs")) for f in names if f.endswith(".parquet")]
        n_files[size] = len(files)
        back = sinks.read_markdown(spark, out)
        assert sorted(back.select("video_id", "para", "fragment").collect()) == sorted((r[1], r[4], r[5]) for r in rows)
        index = spark.read.parquet(f"{out}/index").collect()
        assert len(index) == 304 and sum(r["bytes"] for r in index) == sum(len(r[5].encode()) for r in rows)
        per = {}
        for r in index:
            per[r["lang"], r["pack"]] = per.get((r["lang"], r["pack"]), 0) + r["bytes"]
        assert all(b < size + 20_001 for b in per.values()) and len(per) == n_files[size]
        one = sinks.read_markdown(spark, out, spark.createDataFrame([("v0007",), ("big",)], "video_id string"))
        assert one.count() == sum(r[1] in ("v0007", "big") for r in rows)
    assert n_files[4_000] > 5 * n_files[40_000]


def test_state_documents_keep_old_fields(spark):
    """Channel: given, else from the name, else the old one; language: given, else the old
    one; legacy names move; repeated ids merge; a failed write changes nothing."""
    d = folder("state")
    modern, legacy = SF.STATE_PREFIXES

    def put(name, doc):
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            json.dump(doc, f)
    put(f"{legacy}a.json", {"channel": "@old-a", "videos": [{"id": "gone"}], "detected_language": "pt"})
    put("custom.json", {"detected_language": "fr", "videos": [{"id": "gone"}], "channel": '@quo"te'})
    put("list.json", [{"id": "gone"}])
    put(f"{modern}z.json", {"channel": "@z", "videos": [{"id": "kept"}]})
    chans = spark.createDataFrame([
        ("a", None, f"{legacy}a.json", None), ("b", "@given", None, "en"), ("c", None, "custom.json", None), ("d", None, "list.json", "es"),
        ("e", "", None, "")], "state_channel string, handle string, file string, detected_language string")
    rows = spark.createDataFrame([
        ("a", "v1", 2, "N/A", "N/A", False, ["p"]), ("a", "v1", 5, "2024-01-01", 'T "x"', True, ["q", "p"]), ("a", "v0", 3, None, None, None, None),
        ("b", "v1", 1, "2024-02-02", "B", False, None), ("c", "v2", 1, None, "é", None, None), ("a", None, 0, None, "none", None, None),
        ("a", "", 0, None, "none", None, None), ("nobody", "v9", 1, None, None, None, None)],
        "state_channel string, video_id string, ord long, publish_date string, title string, subtitle_downloaded boolean, playlists array<string>")

    def docs():
        return {n: json.load(open(os.path.join(d, n), encoding="utf-8")) for n in os.listdir(d)}
    before = docs()
    bad = rows.withColumn("title", F.when(F.col("video_id") == "v2", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_channel_state(bad, chans, d)
    assert docs() == before
    for _ in range(2):  # a second write gives the same documents
        sinks.write_channel_state(rows, chans, d)
        got = docs()
        assert {n: (x["channel"], x.get("detected_language"), [v["video_id"] for v in x["videos"]]) for n, x in got.items() if n[-6:] != "z.json"} == {
            f"{modern}a.json": ("@a", "pt", ["v1", "v0"]), f"{modern}b.json": ("@given", "en", ["v1"]), "custom.json": ('@quo"te', "fr", ["v2"]),
            "list.json": ("N/A", "es", []), f"{modern}e.json": ("@e", None, [])}
        assert got[f"{modern}z.json"] == before[f"{modern}z.json"] and len(got) == 6
        v1 = got[f"{modern}a.json"]["videos"][0]
        assert (v1["title"], v1["publish_date"], v1["subtitle_downloaded"], v1["playlists"]) == ('T "x"', "2024-01-01", True, ["p", "q"])


def test_folders_are_listed_two_levels_deep(spark):
    d = folder("tree")
    for name in ("a.srt", "sub/b.md", "sub/empty.json", "sub/deep/c.srt", ".git/d.srt", "sub/e.txt", "with space/f+g%20.srt", "no-ending"):
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        with open(os.path.join(d, name), "w") as f:
            f.write("" if "empty" in name else "x")
    got = sorted((r["dir"], r["name"], r["ext"], r.uri, r.mtime_s > 1_600_000_000) for r in SF.list_files(spark, "file://" + d).collect())
    assert got == [("", "a.srt", "srt", f"{d}/a.srt", True), ("sub", "b.md", "md", f"{d}/sub/b.md", True),
                   ("sub", "empty.json", "json", f"{d}/sub/empty.json", True), ("with space", "f+g%20.srt", "srt", f"{d}/with space/f+g%20.srt", True)]
    read = spark.read.text(d + "/with space").select(SF.plain_path(F.col("_metadata.file_path"))).first()[0]
    assert read == f"{d}/with space/f+g%20.srt"


def test_repeated_outcomes_give_one_row(spark):
    plan = spark.createDataFrame([("v", "fetch", "2024-01-01", False, False)], "video_id string, action string, publish_date string, "
                                 "subtitle_downloaded boolean, has_no_subtitle boolean")
    outcomes = spark.createDataFrame([("v", 1, False), ("v", 0, True), ("v", 0, True)], SS.OUTCOME_SCHEMA)
    got = ST.apply_outcomes(plan, outcomes, "2024-06-01").collect()
    assert [(r.outcome, r.subtitle_downloaded) for r in got] == [("downloaded", True)]


def test_no_local_folder_on_a_cluster():
    from captionflow import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_repeated_ids_do_not_multiply_rows(spark):
    """Two metadata files of a video, an archive copy, a repeated history row."""
    state = spark.createDataFrame([("v", "N/A", "N/A", None)], "video_id string, publish_date string, title string, info_downloaded boolean")
    info = spark.createDataFrame([("v", 2, "second", "20240202", 2.0, "c2", "u", 2), ("v", 1, "", "20240101", 1.0, "c1", "u", 1),
                                  ("v", 1, "", "20240101", 1.0, "c1", "u", 1)],
                                 "video_id string, ord long, title string, upload_date string, duration double, channel string, uploader string, view_count long")
    got = ST.harvest_metadata(state, info).collect()
    assert [(r.title, r.publish_date, r.channel, r.view_count, r.info_downloaded) for r in got] == [("N/A", "2024-01-01", "c1", 1, True)]
    assert ST.harvest_metadata(state, info.drop("ord")).count() == 1
    healed = ST.heal_metadata(state, spark.createDataFrame([("v", "T", "2024-01-01")] * 2 + [("v", "U", "N/A")], "video_id string, title string, date string"))
    assert [(r.title, r.publish_date, r.healed, r.info_downloaded) for r in healed.collect()] == [("T", "2024-01-01", True, True)]
    listing = spark.createDataFrame([("v", 1, "N/A", "t")], "video_id string, ord long, publish_date string, title string")
    history = spark.createDataFrame([("v", 9, "2024-09-09"), ("v", 3, "2024-03-03"), ("v", 1, "N/A")], "video_id string, ord long, publish_date string")
    assert [r.publish_date for r in ST.fill_dates(listing, history).collect()] == ["2024-03-03"]


def test_null_flags_count_as_false(spark):
    state = spark.createDataFrame([("a", None, None, None, "2024-01-01"), ("b", None, True, None, None)],
                                  "video_id string, subtitle_downloaded boolean, info_downloaded boolean, has_no_subtitle boolean, publish_date string")
    present = spark.createDataFrame([("b", True, False)], "video_id string, has_srt boolean, has_md boolean")
    plan = ST.plan_work(state, present)
    got = {r.video_id: (r.action, r.subtitle_downloaded, r.info_downloaded, r.has_no_subtitle) for r in plan.collect()}
    assert got == {"a": ("fetch", False, False, False), "b": ("convert", True, True, False)}
    outcomes = spark.createDataFrame([("a", 0, None)], SS.OUTCOME_SCHEMA)
    r = ST.apply_outcomes(state.withColumn("action", F.lit("fetch")), outcomes, "2024-06-01").where("video_id = 'a'").first()
    assert (r.outcome, r.subtitle_downloaded, r.has_no_subtitle) == ("skipped", False, True)
