"""Methods against slow reference versions: solvers, divergences, estimation."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as E
from captionflow.llm import pii, quality, quality_rules, toxicity
from captionflow.llm.common import first_by_bytes, size_checked

from . import brute
from .helpers import AWKWARD, awkward


def test_hinge_loss_against_projected_gradient():
    """The dual's optimum, found by many small projected steps on the dense problem."""
    rng = np.random.default_rng(1)
    x = [np.sort(rng.choice(12, rng.integers(1, 6), replace=False)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.4, 1.0, -1.0)
    scale, cost = rng.normal(size=12), np.where(y > 0, 1.0, 0.5)
    w, b = quality.dual_coordinate_descent(x, y, scale, cost, epochs=3000)
    dense = np.zeros((40, 13))
    for i, s in enumerate(x):
        dense[i, s] = scale[s] / (np.linalg.norm(scale[s]) or 1.0)
    dense[:, 12] = 1.0
    q = (dense * y[:, None]) @ (dense * y[:, None]).T
    alpha = np.zeros(40)
    for _ in range(60_000):
        alpha = np.clip(alpha + (1 - q @ alpha) / np.linalg.norm(q, 2), 0, cost)
    want = (alpha * y) @ dense
    assert np.allclose(w, want[:12] * scale, atol=2e-3) and abs(b - want[12]) < 2e-3


def test_logistic_against_gradient_descent():
    rng = np.random.default_rng(2)
    x = [np.sort(rng.choice(8, rng.integers(0, 5), replace=False)).astype(np.int32) for _ in range(60)]
    dense, y = rng.random((60, 2)), (rng.random(60) < 0.3).astype(float)
    w, e, b = toxicity.logistic(x, dense, y, 8, ridge=1e-2)
    a = np.zeros((60, 11))
    for i, s in enumerate(x):
        a[i, s] = 1
    a[:, 8:10], a[:, 10] = dense, 1
    weight = np.where(y > 0, math.sqrt((1 - y).sum() / y.sum()), 1.0)
    weight /= weight.sum()
    ridge = np.array([1e-2] * 10 + [0.0])
    v = np.zeros(11)
    for _ in range(40_000):
        v -= 0.5 * (a.T @ (weight * (1 / (1 + np.exp(-a @ v)) - y)) + ridge * v)
    assert np.allclose(np.concatenate((w, e, [b])), v, atol=5e-3)


def test_groups_split_what_does_not_occur_together():
    rng = random.Random(3)
    a, b = list(range(100, 110)), list(range(500, 506))
    x = [np.array(sorted(rng.sample(a if k % 2 else b, 4) + [900]), np.int32) for k in range(80)]
    got = dict(zip([*a, *b], toxicity.groups(x, np.array([*a, *b]))))
    assert len({got[s] for s in a}) == len({got[s] for s in b}) == 1 and got[a[0]] != got[b[0]]
    labels = toxicity.category_labels([*x, np.array([100], np.int32)], np.array([1.0] * 80 + [0.0]), np.array([*a, *b]))
    assert (labels[:80, :2].sum(axis=1) == 1).all() and (labels[80] == 0).all() and (labels[:80, 2] == 1).all()


def test_chain_on_other_words():
    """Toxic words that no list knows: the chain finds groups and predicts held-out rows;
    an indicator of one fold's rows alone has no weight in that fold's predictions."""
    rng = random.Random(4)
    plain, bad = [f"w{k}" for k in range(300)], [[f"zork{k}" for k in range(5)], [f"blag{k}" for k in range(5)]]

    def row(toxic):
        words = rng.sample(plain, 40) + (rng.sample(rng.choice(bad), 2) if toxic else [])
        return toxicity.features(np.frombuffer(" ".join(words).encode(), np.uint8))
    y = np.array([float(k % 3 == 0) for k in range(900)])
    x = [row(t) for t in y]
    learn = range(600)
    known = np.flatnonzero(toxicity.telling(toxicity.counted(x, y, np.arange(600)), np.array([400, 200])) >= toxicity.MIN_RATIO)
    chain = toxicity.fit_chain(x[:600], toxicity.category_labels(x[:600], y[:600], known), toxicity.NAMES)
    p = np.array([chain.predict(s) for s in x])
    assert ((p[600:, 2] >= toxicity.THRESHOLD) == y[600:]).mean() > 0.97 and len(learn) == 600
    groups = p[600:][y[600:] > 0][:, :2] > 0.5
    assert 0.2 < groups[:, 0].mean() < 0.8 and (groups.sum(axis=1) == 1).mean() > 0.9
    assert [len(e) for e in chain.earlier] == [0, 1, 2]


def test_ratios_do_not_know_rows_set_aside(spark):
    """The calibration rows' own indicators are not in the counts."""
    docs = spark.createDataFrame([(d, f"same words u{d}x") for d in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(400)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    sample = quality.sample_rows(docs, quality.training_labels(labels, "quality"), quality.SAMPLE_PER_CLASS)
    shared = np.bincount(np.concatenate([s for _, s in sample]), minlength=quality.SLOTS)
    for k, (_, slots) in enumerate(sample):
        own = slots[(shared[slots] == 1) & (slots >= quality.SHAPE_SLOTS)]
        if len(own):
            nothing = np.abs(model.scale[own] - model.scale[shared == 0].mean()) < 1e-9
            assert nothing.all() == (k % 4 == 3)


def test_samples_and_broadcasts_are_bounded_by_bytes(spark):
    rows = spark.createDataFrame([(k, "x" * 100) for k in range(50)], "k long, v string")
    assert [r["k"] for r in first_by_bytes(rows, ["k"], lambda r: len(r["v"]), 1_000)] == list(range(10))

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(size_checked(rows)) and not hinted(size_checked(rows, most_bytes=3_000)) and not hinted(size_checked(rows, rows=10))
    assert hinted(size_checked(rows.limit(0)))


# ---------------------------------------------------------------- quality rules
def divergence(p, q):
    a, b = sum(p), sum(q)
    if not a or not b:
        return 0.0
    out = 0.0
    for x, y in zip(p, q):
        x, y = x / a, y / b
        m = (x + y) / 2
        out += (0.5 * x * math.log2(x / m) if x else 0) + (0.5 * y * math.log2(y / m) if y else 0)
    return out


def histograms(text, lang):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    kinds = Counter("lower" if "a" <= c <= "z" else "space" if c in " \t\n\x0b\x0c\r" else "symbol" if c in "#*$%&|<>" else
                    "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "other_script" if ord(c) > 127 else "punctuation"
                    for c in text)
    listed = quality_rules.COMMON.get(lang or "", ())
    bare = Counter(w.lower().strip(".,;:!?\"'()") for w in words)
    common = [bare[c] for c in listed]
    return [kinds[k] for k in quality_rules.CLASSES], common, len(words), len(text)


def check_divergences(rows, docs):
    made = [(lang or "", *histograms(text, lang)) for _, text, lang in docs]
    classes, words, n_words = defaultdict(lambda: [0] * 7), defaultdict(lambda: [0] * 8), Counter()
    for lang, c, w, n, _ in made:
        classes[lang] = [a + b for a, b in zip(classes[lang], c)]
        words[lang] = [a + b for a, b in zip(words[lang], w or [0] * 8)]
        n_words[lang] += n
    for r, (lang, c, w, n, chars), (_, text, _) in zip(rows, made, docs):
        one = divergence(c, classes[lang]) if chars >= quality_rules.MIN_CHARS_COMPARED else 0.0
        two = divergence([*w, n - sum(w)], [*words[lang], n_words[lang] - sum(words[lang])]) \
            if w and n >= quality_rules.MIN_WORDS_COMPARED else 0.0
        assert abs(r["char_divergence"] - one) < 1e-9 and abs(r["word_divergence"] - two) < 1e-9
        counts = brute.rule_counts(text)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and one <= quality_rules.MAX_CHAR_DIVERGENCE and two <= quality_rules.MAX_WORD_DIVERGENCE)


def test_divergences_by_brute_force(spark, sf_small):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in E.queries()["op9_quality_rules"](spark, sf_small).collect()}
    check_divergences([got[d] for d, _, _ in docs], docs)
    assert any(not r["kept"] and not r["base_failed"] for r in got.values())


def test_divergences_of_awkward_rows_and_a_lone_language(spark):
    rows = [(d, t) for d, t in dict((d, t) for d, t in AWKWARD if d is not None).items()]
    odd = "123 456 #### zzz " * 60
    rows += [(61, odd)]
    df = awkward(spark, rows).selectExpr("doc_id", "text", "if(doc_id = 61, 'xx', lang) AS lang")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    check_divergences([got[d] for d, _, _ in docs], docs)
    assert got[61]["char_divergence"] == 0  # the one document of its language is its reference


# ---------------------------------------------------------------- weak supervision
def test_reliabilities_of_known_labelers():
    """Votes drawn from labelers of known reliability: estimation finds them, and the share
    of true candidates; and it climbs the likelihood of the votes."""
    rng = random.Random(5)
    yes = [{1: 0.9, 0: 0.02, None: 0.08}, {1: 0.7, 0: 0.1, None: 0.2}, {1: 0.8, 0: 0.2, None: 0.0}, {1: 0.6, 0: 0.3, None: 0.1}]
    no = [{1: 0.1, 0: 0.5, None: 0.4}, {1: 0.2, 0: 0.6, None: 0.2}, {1: 0.1, 0: 0.9, None: 0.0}, {1: 0.2, 0: 0.7, None: 0.1}]

    def draw(of):
        return rng.choices(list(of), list(of.values()))[0]
    counts = Counter(tuple(draw(of) for of in (yes if rng.random() < 0.6 else no)) for _ in range(20_000))
    patterns = sorted(counts.items(), key=repr)
    prior, got_yes, got_no = pii.estimate_reliabilities(patterns)
    assert abs(prior - 0.6) < 0.03
    for got, want in ((got_yes, yes), (got_no, no)):
        assert all(abs(g[v] - w[v]) < 0.05 for g, w in zip(got, want) for v in (1, 0, None))

    def likelihood(prior, y, n):
        return sum(k * math.log(prior * math.prod(a[v] for a, v in zip(y, votes)) + (1 - prior) * math.prod(a[v] for a, v in zip(n, votes)))
                   for votes, k in patterns)
    steps = [likelihood(*pii.estimate_reliabilities(patterns, rounds=r)) for r in (1, 2, 5, 20, 200)]
    assert all(b >= a - 1.0 for a, b in zip(steps, steps[1:]))


def test_span_classifier_against_newton():
    rng = random.Random(6)
    rows = [(pii._inputs(rng.randrange(4), tuple(rng.choice((1, 0, None)) for _ in pii.VOTERS), rng.randrange(5), rng.randrange(2), rng.randrange(2)),
             rng.random(), rng.randrange(1, 30)) for _ in range(60)]
    w = np.array(pii.train_classifier(rows, steps=40_000))
    x, y, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    n /= n.sum()
    v = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ v))
        v -= np.linalg.solve((x.T * (n * p * (1 - p))) @ x + 1e-4 * np.eye(len(v)), x.T @ (n * (p - y)) + 1e-4 * v)
    assert np.abs(x @ (w - v)).max() < 0.05


@pytest.mark.parametrize("k", [0, 1])
def test_divergence_bounds(k):
    assert divergence([1, 0], [0, 1]) == 1.0 and divergence([k + 1, 2], [2 * k + 2, 4]) == 0.0
