"""The methods behind the operators: planted cases, hard cases and properties, and the
pipeline against brute force, stage by stage."""

import base64
import bz2
import gzip
import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from captionflow.llm import components, decontamination, packing, quality, secrets, simhash, toxicity
from captionflow.llm.common import table

from . import brute
from .helpers import AWKWARD, awkward, empty
from .test_contracts import check_packing


def grouped(nodes, linked):
    """node -> smallest node of its component, by comparing all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- 1
def test_least_squares_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 4, (12, 30)).astype(float), rng.integers(0, 500, 12).astype(float)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-4 and np.abs(gain[x > 1e-6]).max(initial=0) < 1e-4


def test_plan_stays_within_the_supply():
    rng = np.random.default_rng(2)
    for top in (0, 1, 7, 100_000):
        histogram = np.concatenate(([0], rng.integers(0, top + 1, 64)))
        used = np.zeros(65, np.int64)
        for combo, times in packing.plan_counts(histogram, 64):
            assert sum(combo) == 64 and 2 <= len(combo) <= packing.DEPTH and times > 0
            np.add.at(used, list(combo), times)
        assert (used <= histogram).all()
        assert top < 100_000 or used.sum() > 0


# ---------------------------------------------------------------- 2 and 10
def test_hinge_loss_fit_separates_and_stays_in_its_box():
    rng = np.random.default_rng(3)
    x = [np.sort(rng.choice(np.arange(40) if i % 2 else np.arange(20, 60), 8, replace=False)) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    w, b = quality.dual_coordinate_descent(x, y, np.ones(60), np.ones(200), epochs=200)
    margin = np.array([w[i].sum() / np.sqrt(len(i)) + b for i in x])
    assert (np.sign(margin) == y).mean() > 0.9 and w[:20].mean() > 0 > w[40:].mean()


def test_later_models_read_earlier_probabilities():
    rng = np.random.default_rng(4)
    first = rng.random(600) < 0.5
    x = [np.array(sorted({100 + int(f) * 50 + int(k) for k in rng.integers(0, 20, 6)}), np.int32) for f in first]
    y = np.column_stack((first, first)).astype(float)
    chain = toxicity.fit_chain(x, y, ("one", "two"))
    assert len(chain.earlier[0]) == 0 and chain.earlier[1][0] > 0
    got = np.array([chain.predict(i) for i in x])
    assert ((got > 0.5) == y).mean() > 0.98


# ---------------------------------------------------------------- 5
def test_linked_fingerprints_share_an_anchor():
    rng = random.Random(5)
    for _ in range(1500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(3)):
            b ^= 1 << bit
        key, who = simhash.anchors(np.array([a, b], np.uint64))
        assert set(key[who == 0].tolist()) & set(key[who == 1].tolist())


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_of_crowded_and_sparse_fingerprints(spark, bits):
    """One ball of over ``BUCKET`` fingerprints round a code word, smaller ones, and
    chains whose ends are far apart."""
    rng = random.Random(6 + bits)
    fps = {0, (1 << 64) - 1}
    for i, j in itertools.combinations(range(64), 2):
        fps.update({1 << i} if rng.random() < 0.3 else set())
        fps.update({1 << i | 1 << j} if rng.random() < 0.25 else set())
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            fps.add(at)
            for bit in rng.sample(range(64), rng.randrange(1, 4)):
                at ^= 1 << bit
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = grouped(fps, lambda a, b: (a ^ b).bit_count() <= bits)
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["fp"] % (1 << 64): r["component_id"] for r in simhash.fingerprint_components(rows, bits).collect()}
    ids = {f: i for i, f in enumerate(fps)}
    least = {}
    for f, root in want.items():
        least[root] = min(least.get(root, 1 << 62), ids[f])
    assert got == {f: least[root] for f, root in want.items()}


def test_simhash_awkward(spark):
    texts = [(d, t) for d, t in AWKWARD if d is not None]
    got = sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(awkward(spark, texts)).collect())
    want = brute.simhash_components(texts)
    assert got == sorted((d, *want[d]) for d, _ in texts)
    assert simhash.simhash_components(empty(spark)).collect() == []
    kept = simhash.keep_one_per_component(awkward(spark, texts))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert simhash.keep_one_per_component(empty(spark)).collect() == []


def test_documents_without_ids_are_told_apart(spark):
    rng = random.Random(7)
    some = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(999)) for _ in range(60)) for _ in range(4)]
    kept = simhash.keep_one_per_component(awkward(spark, [(None, t) for t in some + some])).collect()
    assert sorted(r["text"] for r in kept) == sorted(some)


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame([*path, *star, *star, (5, 5), (None, 7), (7, None)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{1000 + i: 1000 for i in range(300)}}
    assert components.connected_components(edges.limit(0)).collect() == []


# ---------------------------------------------------------------- 6
SECRET = "password=hunter2hunter2"


def b64(x: bytes) -> str:
    return base64.b64encode(x).decode()


@pytest.mark.parametrize("layer", [
    "".join(f"%{b:02x}" for b in SECRET.encode()), "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "".join(f"\\x{ord(c):02x}" for c in SECRET), b64(SECRET.encode()), b64(gzip.compress(SECRET.encode())),
    b64(zlib.compress(SECRET.encode())), b64(bz2.compress(gzip.compress(SECRET.encode()))),
    b64(b64(b64(SECRET.encode()).encode()).encode()), b64("".join(f"%{b:02x}" for b in SECRET.encode()).encode()),
    b64(("a " + "".join(f"\\u{ord(c):04x}" for c in SECRET) + " z").encode()).replace("+", "-").replace("/", "_"),
])
def test_secrets_in_layers(layer):
    text = f"héllo [ {layer} ] end"
    base, spans, unopened = secrets.scan(text)
    assert base == [] and unopened == 0 and len(spans) == 1
    (a, kind, z), at = spans[0], text.index(layer)
    assert kind == 0 and at <= a < z <= at + len(layer)
    assert secrets.redact(text, spans).startswith("héllo [ ") and secrets.redact(text, spans).endswith(" ] end")
    assert secrets.scan(secrets.redact(text, spans))[1] == []


def test_layers_end(monkeypatch):
    deep = SECRET
    for _ in range(12):
        deep = b64(deep.encode())
    assert len(secrets.scan(deep)[1]) == 1
    percent = "%25" * 30
    assert secrets.scan(percent)[1:] == ([], 0)
    monkeypatch.setattr(secrets, "MAX_DECODED", 1 << 20)
    bomb = b64(gzip.compress(bytes((1 << 20) + 1)))
    assert secrets.scan(f"x {bomb} y")[2] == 1 and secrets.redacted_text(f"x {bomb} y") == "x [SECRET] y"


def test_members_and_large_layers(monkeypatch):
    import lzma

    import zstandard
    plain = b"nothing here "
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        for data in (pack(plain) + pack(SECRET.encode()), pack(plain) + pack(b"password=hunt") + pack(b"er2hunter2"),
                     pack(plain) + b"\0" * 8 + gzip.compress(SECRET.encode())):
            if pack is zstandard.compress and b"\0" * 8 in data:
                continue
            text = f"x {b64(data)} y"
            assert secrets.scan(text)[1:] == ([(2, 0, len(text) - 2)], 0), pack
    # streams of many pieces: wherever the secret stands, and compressed once more
    monkeypatch.setattr(secrets, "PIECE", 1 << 12)
    rng = random.Random(3)
    noise = "".join(rng.choice("plain words, é. ") for _ in range(1 << 16)).encode()
    for before in (0, 1 << 10, (1 << 12) - 8, (1 << 13) - 5, 1 << 16):
        inner = noise[:before] + b" " + SECRET.encode() + b" " + noise
        for data in (gzip.compress(inner), bz2.compress(gzip.compress(inner)), lzma.compress(zlib.compress(bz2.compress(inner))),
                     zstandard.compress(gzip.compress(zstandard.compress(inner)))):
            text = f"x {b64(data)} y"
            _, found, unopened = secrets.scan(text)  # stored bytes read at other places may look like more
            assert (2, 0, len(text) - 2) in found and {s[::2] for s in found} == {(2, len(text) - 2)} and unopened == 0
    # values, escapes and base64 runs of any length over the ends of pieces
    for inner in (b"password=" + b"h" * 50_000, b"password" + b" " * 20_000 + b"=" + b" " * 9_000 + b"hunter2hunter2",
                  "".join(f"%{b:02x}" for b in SECRET.encode() * 2_000).encode(),
                  b64(gzip.compress(rng.randbytes(30_000) + SECRET.encode())).encode(), (SECRET + " ").encode("utf-16") * 900):
        text = f"x {b64(gzip.compress(noise[:4000] + b',' + inner + b', end'))} y"
        assert (2, 0, len(text) - 2) in secrets.scan(text)[1] and secrets.scan(text)[2] == 0, inner[:20]
    # an unbroken run that is too long is counted, and redacted whole
    monkeypatch.setattr(secrets, "MAX_RUN", 1 << 14)
    large = b64(gzip.compress(b"plain, " + b"x" * (1 << 16) + b", words"))
    assert secrets.scan(f"x {large} y")[2] == 1 and secrets.redacted_text(f"x {large} y") == "x [SECRET] y"


def test_undecodable_bytes_hide_nothing():
    """One bad byte or point beside an escaped secret leaves the secret readable."""
    hexed, wide = "".join(f"%{b:02x}" for b in SECRET.encode()), "".join(f"\\u{ord(c):04x}" for c in SECRET)
    for layer in (f"%E9{hexed}", f"{hexed}%FF", f"%c3{hexed}%e2%82", f"\\u{{FFFFFF}}{wide}", f"{wide}\\ud800", f"\\UFFFFFFFF{wide}",
                  "".join(f"\\U{ord(c):08x}" for c in SECRET), f"{wide[:30]}\\x70\\xff"[:0] + f"\\xff{wide}",
                  b64(b"\xff\xfe\xfd" + SECRET.encode() + b"\xff"), b64(f"%E9{hexed}%FF".encode())):
        text = f"héllo [ {layer} ] end"
        assert [k for _, k, _ in secrets.scan(text)[1]] == [0], layer
        assert secrets.scan(secrets.redacted_text(text))[1] == []


def test_random_nestings():
    """Any chain of encodings, with noise around each layer, is undone."""
    import lzma

    import zstandard
    rng = random.Random(11)

    def noise(kind):
        return rng.choice([b"", b" ", b", ", b"\n", b"; x ", b"(" if kind else b"%E9 ", "é ".encode()])
    wraps = {
        "url": lambda b: "".join(f"%{x:02X}" for x in b).encode(),
        "unicode": lambda b: "".join(f"\\u{ord(c):04x}" for c in b.decode("utf-8", "replace")).encode(),
        "hexed": lambda b: "".join(f"\\x{ord(c):02x}" if ord(c) < 256 else c for c in b.decode("utf-8", "replace")).encode(),
        "base64": lambda b: base64.b64encode(b), "web": lambda b: base64.urlsafe_b64encode(b),
        "gzip": lambda b: base64.b64encode(gzip.compress(b)), "bz2": lambda b: base64.b64encode(bz2.compress(b)),
        "xz": lambda b: base64.b64encode(lzma.compress(b)), "zstd": lambda b: base64.b64encode(zstandard.compress(b)),
        "twice": lambda b: base64.b64encode(zlib.compress(gzip.compress(b))),
        "lines": lambda b: b"\n> ".join(base64.b64encode(b)[i:i + 12] for i in range(0, len(base64.b64encode(b)), 12)),
    }
    for k in range(150):
        chain = [rng.choice(list(wraps)) for _ in range(rng.randrange(1, 5))]
        data = SECRET.encode()
        for name in chain:
            data = noise(name == "lines") + wraps[name](b" " + data + b" ") + rng.choice([b"", b" ", b"\n", b", y"])
        text = "see " + data.decode("utf-8", "replace")
        found = secrets.scan(text)
        assert any(kind == 0 for _, kind, _ in found[1]), chain
        assert secrets.scan(secrets.redacted_text(text))[1] == [], chain


@pytest.mark.parametrize("inner", [SECRET.encode(), gzip.compress(SECRET.encode()), bz2.compress(SECRET.encode()),
                                   SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), b"\1\2\0\3" * 1500 + SECRET.encode()])
def test_base64_with_something_in_front(inner):
    code = b64(inner)
    for front in ("https://h.example/t/", "session_", "id-", "a", "ab", "abc", "abcd/ef", "/"):
        text = f"see {front}{code} end"
        (a, kind, z), = secrets.scan(text)[1]
        assert kind == 0 and a <= text.index(code) and z == len(text) - 4, front


@pytest.mark.parametrize("width", [12, 20, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  ", "\n> ", "\r\n> > "])
def test_wrapped_base64(width, end):
    for inner in (b"x" * 43 + SECRET.encode() + b"y" * 40, gzip.compress(random.Random(1).randbytes(400) + SECRET.encode())):
        code = b64(inner)
        lines = end.join(code[i:i + width] for i in range(0, len(code), width))
        text = f"-----BEGIN MESSAGE-----{end}{lines}{end}-----END MESSAGE-----"
        assert any(kind == 0 for _, kind, _ in secrets.scan(text)[1])
        assert secrets.scan(secrets.redacted_text(text))[1] == []


def test_redaction(spark):
    assert secrets.redact("ab", []) == "ab"
    assert secrets.redact("0123456789", [(1, 0, 4), (2, 1, 6), (7, 0, 8)]) == "0[SECRET]6[SECRET]89"
    texts = [*AWKWARD, (50, f"x {SECRET} y"), (50, f"x {SECRET} y")]
    got = secrets.redact_documents(awkward(spark, texts))
    assert got.columns == awkward(spark).columns and got.schema == awkward(spark).schema
    rows = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=repr)
    # some awkward rows hold long runs of digits, which the hex rule reports
    want = [(d, t and re.sub(r"[0-9a-f]{32,}|password=\w+", "[SECRET]", t)) for d, t in texts]
    assert rows == sorted(((d, t, None if t is None else len(t)) for d, t in want), key=repr)
    assert len(secrets.scan_documents(awkward(spark)).collect()) == len(AWKWARD)
    assert secrets.redact_documents(empty(spark)).collect() == []


# ---------------------------------------------------------------- 8
ITEM = ("A farmer named Tom sells 14 boxes of apples to Mary for 3 dollars each, and then gives 14 more boxes "
        "away to Tom's brother. How much money does Tom earn from the sale to Mary in total?")


def test_reparameterised_questions(spark):
    renamed = ITEM.replace("Tom", "Bob").replace("Mary", "Ann").replace("14", "250").replace("3 dollars", "9 euros")
    crossed = ITEM.replace("14 more", "15 more").replace("Tom's", "Ann's").replace("does Tom", "does Joe")
    other = "A farmer sells boxes of apples in the town every week and keeps the money for a new roof on the barn."
    docs = awkward(spark, [*AWKWARD, (60, "Intro text. " + ITEM + " Outro."), (61, "Intro. " + renamed + " More words here."),
                           (62, "Intro. " + crossed), (63, other), (64, "w " * 30_000 + ITEM)])
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (1, ITEM)], "item_id long, text string")
    got = decontamination.contaminated(docs, items).collect()
    assert len(got) == len(AWKWARD) + 5
    assert {r["doc_id"] for r in got if r["contaminated"]} == {60, 61, 64}
    kept = decontamination.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) + 2
    assert decontamination.keep_clean(docs, items.limit(0)).count() == docs.count()
    assert decontamination.contaminated(empty(spark), items).collect() == []


def test_benchmark_blocks_find_what_one_block_finds(spark, sf_small, monkeypatch):
    docs, items = table(spark, sf_small, "documents"), table(spark, sf_small, "benchmark")
    one = {r["doc_id"]: sorted(r["items"]) for r in decontamination.contaminated(docs, items).collect()}
    whole = list(decontamination.benchmark_blocks(items))
    few = list(decontamination.benchmark_blocks(items, rows=max(1, items.count() // 3)))
    assert len(whole) == 1 and len(few) >= 3
    monkeypatch.setattr(decontamination, "benchmark_blocks", lambda b: iter(few))
    assert {r["doc_id"]: sorted(r["items"]) for r in decontamination.contaminated(docs, items).collect()} == one
    rough = awkward(spark, [*AWKWARD, *AWKWARD])
    kept = decontamination.keep_clean(rough, items)
    assert kept.schema == rough.schema and kept.count() == 2 * len(AWKWARD)
    assert decontamination.keep_clean(docs, items).count() == sum(not x for x in one.values())


def test_repeated_benchmark_rows_count_once(spark):
    docs = awkward(spark, [(60, "Intro text. " + ITEM)])
    items = spark.createDataFrame([(1, ITEM)] * 40 + [(2, ITEM)] * 2, "item_id long, text string")
    assert [r["items"] for r in decontamination.contaminated(docs, items).collect()] == [[1, 2]]
    assert sum(len(b.ids) for b in decontamination.benchmark_blocks(items, rows=1)) == 2


def found(items, text):
    """Numbers of the items (from 0) that a text contains."""
    block = decontamination.Block.of([(i, t.encode()) for i, t in enumerate(items)], decontamination.WINDOW)
    return [i for i, _ in block.matches(np.frombuffer(text.encode(), np.uint8), decontamination.COVERAGE)]


def test_items_of_placeholders():
    items = ["Compute 12 + 7 * 3 - 4", "3, 7, 12, 18, 25, 33, 42, 52, 63, 75, what is next", "42",
             "Then Anna Berta Carla Doris Emma Frida Greta Hanna met"]
    for i, t in enumerate(items):
        assert i in found(items, f"some words. {t}. some more")
    assert found(items, "Compute 13 + 7 * 3 - 4 and 4, 7, 13, 18, 26, 33, 43, 52, 64, 75 so") == []
    # literal windows do not stand in the way of new values elsewhere
    mixed = "Add 1 2 3 4 5 6 7 8 9 10 11 and tell me how many sheep the old farmer has to buy"
    assert found([mixed], mixed.replace("1 2 3", "7 5 1").replace("4 5", "99 98")) == [0]


def test_changes_of_the_word_count():
    w = ITEM.split()
    for changed in (" ".join([*w[:19], "extra", *w[19:]]), ITEM.replace("14", "1,250"), ITEM.replace("14", "2.5"),
                    ITEM.replace("Mary", "Eve").replace("Tom", "Mary Ann"), " ".join([*w[:14], *w[15:]]),
                    " ".join([*w[:12], "one", "two", *w[12:25], *w[26:]])):
        assert found([ITEM], f"Intro text here. {changed} More words follow.") == [0], changed
    far = " ".join([*w[:13], *["filler"] * 200, *w[13:26], *["filler"] * 200, *w[26:]])
    assert found([ITEM], far) == []
    # what a chain joins must be consistent as a whole
    assert found([ITEM], " ".join([*w[:19], "extra", *w[19:]]).replace("14 boxes", "15 boxes").replace("14 more", "16 more")) == []


def test_long_verbatim_run():
    rng = random.Random(12)
    item = [f"{rng.choice('bcdfg')}{rng.randrange(10 ** 6)}x" for _ in range(100)]
    assert found([" ".join(item)], "before " + " ".join(item[30:75]) + " after") == [0]
    assert found([" ".join(item)], "before " + " ".join(item[30:55]) + " after") == []


def test_letter_case_hides_no_copy():
    for item in (ITEM, ITEM.replace("Tom", "Élodie").replace("Mary", "Жанна")):
        for copy in (item.lower(), item.upper(), item.title(), item.lower().replace("14", "250")):
            assert found([item], f"intro text. {copy} more words.") == [0], copy
    # capitals of other scripts start names too
    item = ITEM.replace("Tom", "Élodie").replace("Mary", "Жанна")
    assert found([item], item.replace("Élodie", "Ömer").replace("Жанна", "Ольга")) == [0]


# ---------------------------------------------------------------- pipeline
def test_pipeline_by_brute_force(spark, sf_small):
    """Each stage on what the stages before it kept, by plain versions; the classifier's
    decisions are those of its operator, whose accuracy is tested apart."""
    docs = table(spark, sf_small, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "packing"]
    good = {r["doc_id"] for r in quality.score_documents(docs, quality.fit(docs, table(spark, sf_small, "labels")))
            .where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    parts = brute.simhash_components(list(texts.items()))
    texts = {d: t for d, t in texts.items() if parts[d][1] == d}
    items = [" " + " ".join(re.findall(r"\w+", r["text"].lower())) + " " for r in table(spark, sf_small, "benchmark").collect()]

    def clean(t):
        w = " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
        return not any(i in w for i in items)
    texts = {d: secrets.redact(t or "", secrets.scan(t or "")[1]) for d, t in texts.items() if clean(t)}
    assert 0 < len(texts) < len(good) <= docs.count()
    assert all(brute.secret_base(t) == [] for t in texts.values())
    check_packing(corpus_pipeline.run(spark, sf_small).collect(), list(texts.items()))


def test_pipeline_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, quality int")
    docs = awkward(spark)
    kept = quality.keep_good(docs, labels)
    kept = simhash.keep_one_per_component(kept)
    kept = decontamination.keep_clean(kept, spark.createDataFrame([], "item_id long, text string"))
    kept = secrets.redact_documents(kept)
    assert kept.columns == docs.columns
    packed = packing.pack(kept)
    assert packed.where("start = 0").count() == kept.count() > 0
