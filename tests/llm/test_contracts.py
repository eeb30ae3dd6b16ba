"""Registered queries against brute force over the whole smallest table, and the
same operators over awkward rows."""

import re
import zlib

import pytest

import __spark_entry__ as E
from captionflow.llm import (decontamination, licenses, packing, pii, quality, quality_rules, registry, secrets, simhash,
                             toxicity, url_filter)

from . import brute
from .helpers import AWKWARD, awkward, empty

Q = E.queries()


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def counted(rows):
    return sorted(rows, key=repr)


# ---------------------------------------------------------------- 1
def check_packing(rows, texts):
    """``rows`` of the query over ``texts`` (list of (doc_id, text), distinct ids)."""
    from tokenizers import Tokenizer
    import numpy as np
    import public_tokenizers as P
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in texts}
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in (pieces, sequences):
        for k, parts in own.items():
            at = 0
            for a, n in sorted(parts):
                assert a == at and n > 0
                at += n
            if own is pieces:
                assert at == len(ids[k])
            else:
                assert at <= 2048
    assert set(pieces) == set(ids)
    used = sum(map(len, ids.values()))
    return used, len(sequences)


def test_packing(spark, sf_small, docs):
    used, n = check_packing(Q["op1_packing"](spark, sf_small).collect(), docs)
    assert used / (n * 2048) > 0.95


def test_packing_awkward(spark):
    texts = [(d, t) for d, t in dict((d, t) for d, t in AWKWARD if d is not None).items()]
    texts += [(40, "a<|endoftext|> b"), (41, "<|endoftext|>"), (42, "你好<|endoftext|>")]
    check_packing(packing.packing_digest(packing.pack(awkward(spark, texts))).collect(), texts)
    all_rows = packing.pack(awkward(spark))
    assert all_rows.selectExpr("sum(length)").first()[0] == all_rows.where("start = 0").selectExpr("sum(doc_tokens)").first()[0]
    assert packing.packing_digest(packing.pack(empty(spark))).collect() == []


# ---------------------------------------------------------------- 2 and 10
def test_quality_classifier(spark, sf_small, docs):
    got = by_id(Q["op2_quality_classifier"](spark, sf_small))
    assert set(got) == {d for d, _ in docs}
    for d, r in got.items():
        assert r["held_out"] == brute.held_out(d) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def held_out_accuracy(rows, labels, column):
    """(share of label 1 predicted 1, share of label 0 predicted 0) on held-out rows."""
    hit = {0: [0, 0], 1: [0, 0]}
    for r in rows:
        y = labels.get(r["doc_id"])
        if r["held_out"] and y is not None:
            hit[y][0] += r[column] == y
            hit[y][1] += 1
    return hit[1][0] / max(1, hit[1][1]), hit[0][0] / max(1, hit[0][1])


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good, junk = held_out_accuracy(Q["op2_quality_classifier"](spark, sf).collect(), {r["doc_id"]: r["quality"] for r in labels}, "predicted")
    assert good >= 0.99 and junk >= 0.95
    toxic, clean = held_out_accuracy(Q["op10_toxicity"](spark, sf).collect(), {r["doc_id"]: r["toxic"] for r in labels}, "predicted")
    assert toxic >= 0.85 and clean >= 0.99


@pytest.mark.parametrize("labels", ["none", "one class", "both", "nulls"])
def test_classifiers_awkward(spark, labels):
    rows = {"none": [], "one class": [(3, 1, 0), (4, 1, 0)], "both": [(d, d % 2, (d + 1) % 2) for d in range(1, 19)],
            "nulls": [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0), (5, 0, 1)]}[labels]
    table = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for data, n in ((awkward(spark), len(AWKWARD)), (empty(spark), 0)):
        q = quality.score_documents(data, quality.fit(data, table)).collect()
        t = toxicity.score_documents(data, toxicity.fit(data, table)).collect()
        assert len(q) == len(t) == n
        assert all(0 <= r["score"] <= 1 for r in q) and all(0 <= r["p_toxic"] <= 1 for r in t)
    kept = quality.keep_good(awkward(spark), table)
    assert kept.columns == awkward(spark).columns


# ---------------------------------------------------------------- 3
def test_url_filters(spark, sf_small):
    rules = [(r.verdict, r.host, r.path) for r in registry.RULES]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in Q["op3_url_filters"](spark, sf_small).collect()}
    assert set(got) == set(urls)
    for p, url in urls.items():
        host, path = brute.host_path(url)
        verdict, rule = brute.url_rule(host, path, rules)
        r = got[p]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_url_aliases(spark):
    page = "<html><head><link rel='canonical' href='{}'></head>"
    pages = spark.createDataFrame([
        (1, "http://bad.net/es/1", ""), (2, "https://a.org/x?utm_source=f#top", page.format("http://b.org/y")),
        (3, "http://b.org/y", '<meta http-equiv="refresh" content="0; url=http://bad.net/es/1/">'), (4, "http://c.org/", None),
        (5, None, None), (6, "no scheme", ""), (6, "no scheme", ""), (7, "HTTP://WWW.Example.com/en/z?q#f", ""),
        (8, "http://good.com/p", page.format("/es/q")), (9, "http://d.net/es/q", ""), (10, "http://e.org/q", page.format("http://good.com/p")),
        (11, "http://f.org/q", page.format("http://d.net/es/q")), (12, "http://f.org/q", page.format("//e.org/q")), (None, "http://x.com", ""),
    ], "page_id long, url string, html string").selectExpr("*", "'a' AS node", "'b' AS own", "1 AS verdict")
    got = {r["page_id"]: (r["verdict"], r["decided_by"]) for r in url_filter.judge(pages, registry.RULES).collect()}
    assert got[1] == ("block", "rule") and got[2] == ("block", "alias") and got[3] == ("block", "alias")
    assert got[4] == got[5] == got[6] == ("allow", "default") and got[7] == ("allow", "rule")
    # allow and block in one class: allow takes precedence where no rule fits
    assert got[9] == ("block", "rule") and got[8] == ("allow", "rule") and got[10] == got[11] == ("allow", "alias")
    more = spark.createDataFrame([("http://c.org", "https://bad.net/es/1"), (None, "x"), ("http://c.org", "http://c.org")], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, registry.RULES, more).collect()}
    assert got[4] == "block"
    # targets that are no pages decide too
    lone = spark.createDataFrame([(1, "http://a.org/", page.format("http://example.com/en/q")), (3, "example.com/en/a", ""),
                                  (2, "http://b.org/", '<meta http-equiv="refresh" content="0; url=http://bad.net/es/1">'),
                                  (4, "http://c.org/", "<!-- " + page.format("http://bad.net/es/1") + "-->")],
                                 "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(lone, registry.RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert url_filter.judge(pages.limit(0), registry.RULES).collect() == []


def test_link_targets(spark):
    from urllib.parse import urljoin
    page = "http://h.org/a/b/c.html?p=1"
    targets = ["page2.html", "../a", "?id=1", "../../../x/./y/..", ".", "./", "/r?x=1&y=2", "//o.net/z", "https://o.net/a/../b", "#top",
               "d/e/", "x?u=../v", "x;y=1"]
    refresh = ["<meta http-equiv=\"refresh\" content=\"0;url='{}'\">", "<META content='5; URL={}' http-equiv=refresh>",
               '<meta http-equiv=refresh content="0; url={}">']
    link = ['<link rel="canonical" href="{}">', "<link href='{}' rel='canonical'/>", '<link title="a > b" rel=canonical href={}>']
    pages, want = [], []
    for form in refresh + link:
        for t in targets:
            pages.append((len(pages), page, f"<p>{form.format(t.replace('&', '&amp;'))}</p>"))
            want.append((page, urljoin(page, t) if t != "https://o.net/a/../b" else t))
    pages += [(0, page, '<link rel="canonical" href="mailto:a@b.c">'), (0, page, '<link rel="canonical" href="/q?a=1&#38;b=2&#x26;c&amp;amp;">'),
              (0, "http://h.org", '<link rel="canonical" href="r">'), (0, page, '<link rel="icon" href="/canonical">')]
    want += [(page, "http://h.org/q?a=1&b=2&c&amp;"), ("http://h.org", "http://h.org/r")]
    link = '<link rel="canonical" href="{}">'
    pages += [
        (0, page, f'<!-- {link.format("/no")} --><p>'), (0, page, f'<script>"{link.format("/no")}"</script>{link.format("/yes")}'),
        (0, page, f'<base href="http://base.net/x/y"><base href="/no">{link.format("z")}'), (0, page, f'<BASE HREF=/k/>{link.format("z")}'),
        (0, page, f'<base target="_top">{link.format("z")}'), (0, page, f'<!-- {link.format("/no")} <p>{link.format("/no")}'),
        (0, page, f'<!--><base href="//c.net/">--><base href="//b.net/">{link.format("z")}'), (0, "h.org/a", link.format("z")),
        (0, "h.org/a", link.format("http://t.org/z"))]
    want += [(page, "http://h.org/yes"), (page, "http://base.net/x/z"), (page, "http://h.org/k/z"), (page, "http://h.org/a/b/z"),
             (page, "http://c.net/z"), ("h.org/a", "http://t.org/z")]
    got = [tuple(r) for r in url_filter.link_edges(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert sorted(got) == sorted(want)


def test_alias_verdicts_by_brute_force(spark, sf_small):
    """The query's pages with links planted among them, against components of all links."""
    import random
    from urllib.parse import urljoin
    rng = random.Random(13)
    rules = [(r.verdict, r.host, r.path) for r in registry.RULES]
    urls = [r["url"] for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()]

    def node(url):
        if "://" not in url:
            return "schemeless " + url
        bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.split("#")[0])
        bare = re.sub(r"(?<=[?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*(?:&|$)", "", bare)
        bare = re.sub(r"/+$", "", re.sub(r"[?&]+$", "", bare))
        host = re.match(r"[^/?]*", bare)[0]
        return host.lower() + bare[len(host):]
    rows, edges, targets, extra = [], [], [], [f"http://plain{i}.org/d/p.html" for i in range(60)]
    for i, url in enumerate(urls + extra):
        html = ""
        if i >= len(urls) or rng.random() < 0.2:
            uncrawled = [f"http://{h}/{p}/{rng.randrange(9)}" for h in ("www.example.com", "example.com", "un.net", "un.org") for p in ("en", "es")]
            to = rng.choice([rng.choice(urls), rng.choice(extra), "other.html", "../d/p.html", "?id=1&k=2", *uncrawled])
            form = rng.choice(["<link rel='canonical' href='{}'>", '<meta http-equiv="refresh" content="0;url=\'{}\'">'])
            html = form.format(to.replace("&", "&amp;"))
            edges.append((node(url), node(urljoin(url, to))))
            targets.append(urljoin(url, to))
        rows.append((i, url, html))
    rows += [(len(rows), "example.com/en/a", ""), (len(rows) + 1, "un.net/es/1", "")]
    part = brute.components({node(u) for _, u, _ in rows} | {n for e in edges for n in e}, edges)
    own = {i: brute.url_rule(*brute.host_path(u), rules)[0] for i, u, _ in rows}
    said = {}
    for u in [u for _, u, _ in rows] + targets:  # every node votes, crawled or not
        verdict = brute.url_rule(*brute.host_path(u), rules)[0]
        if verdict:
            said[part[node(u)]] = min(verdict, said.get(part[node(u)], "block"))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(
        spark.createDataFrame(rows, "page_id long, url string, html string"), registry.RULES).collect()}
    assert got == {i: own[i] or said.get(part[node(u)], "allow") for i, u, _ in rows}
    assert any(own[i] is None and got[i] == "block" for i in got)


# ---------------------------------------------------------------- 4
def check_licenses(rows, texts):
    for r, (d, t) in zip(rows, texts):
        n, n_base, first, last, base = brute.license_base(t, licenses.PHRASES)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, n_base, first, last, base), d
        labels, best = brute.license_blocks(t, licenses.TEMPLATES, licenses.CONTAINMENT)
        assert r["labels"] == ",".join(sorted(labels | set(filter(None, base.split(","))))), d
        assert abs(r["score"] - best) < 1e-9, d


def test_license_scans(spark, sf_small, docs):
    got = by_id(Q["op4_license_scans"](spark, sf_small))
    check_licenses([got[d] for d, _ in docs], docs)


def test_license_scans_awkward(spark):
    texts = [*AWKWARD, (30, "x UNDER the-MIT\nlicense under the mit license"), (31, "All rights: RESERVED. all rights reserved"),
             (32, "Licensed CC BY-NC 4.0"), (33, "cc by nc cc by nc"), (34, "apache license version 2.0 Apache License, Version 2"),
             (35, "under the Kit license Licensed under Apache License, Version 2 0")]
    table = awkward(spark, texts).coalesce(1)
    got = licenses.scan_documents(table).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted([(d, *brute.license_base(t, licenses.PHRASES)) for d, t in texts], key=lambda r: key(r))
    have = sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got],
                  key=lambda r: key(r))
    assert want == have
    of = {r["doc_id"]: r for r in got}
    check_licenses([of[d] for d, _ in texts if d and d >= 30], [x for x in texts if x[0] and x[0] >= 30])
    assert licenses.scan_documents(empty(spark)).collect() == []


def test_wrapped_and_scattered_notices(spark):
    import textwrap
    filler = " ".join(f"w{i}" for i in range(500))
    texts, want = [], []
    for label, t in licenses.TEMPLATES:
        for width in (20, 40, 72):
            for mark in ("", " * ", "# "):
                body = "\n".join(mark + x for x in textwrap.wrap(t, width))
                for before in ("", filler[:900], filler):
                    texts.append((len(texts), f"{before}\n{body}\n{filler}"))
                    want.append(label)
    scattered = [f" {filler} ".join(t.split()) for _, t in licenses.TEMPLATES]
    texts += [(len(texts) + i, t) for i, t in enumerate(scattered)]
    got = by_id(licenses.scan_documents(awkward(spark, texts)))
    for i, label in enumerate(want):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1, texts[i]
    assert all(got[i]["labels"] == "" and got[i]["score"] == 0 for i in range(len(want), len(texts)))


# ---------------------------------------------------------------- 5
def test_simhash(spark, sf_small, docs):
    want = brute.simhash_components(docs)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in Q["op5_simhash_near_dedup"](spark, sf_small).collect()}
    assert got == want


# ---------------------------------------------------------------- 6
def test_secret_scans(spark, sf_small, docs):
    got = by_id(Q["op6_secret_scans"](spark, sf_small))
    for d, t in docs:
        spans, r = brute.secret_base(t), got[d]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in secrets.KINDS]
        assert r["base_sha256"] == brute.digest(spans, secrets.KINDS)
        assert {f"{k}:{a}:{z}" for a, k, z in spans} <= set(filter(None, r["spans"].split(",")))


# ---------------------------------------------------------------- 7
def check_pii(rows, texts):
    for r, (d, t) in zip(rows, texts):
        spans = brute.pii_base(t)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in spans) for k in pii.KINDS], d
        assert r["base"] == ",".join(f"{k}:{a}:{z}" for a, k, z in sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[1])))), d
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))


def test_pii(spark, sf_small, docs):
    got = by_id(Q["op7_pii"](spark, sf_small))
    for d, t in docs:
        assert got[d]["base_sha256"] == brute.digest(brute.pii_base(t), pii.KINDS)
    rows = by_id(pii.scan_documents(spark.read.parquet(f"{sf_small}/documents.parquet")).withColumnRenamed("base_spans", "base"))
    check_pii([rows[d] for d, _ in docs], docs)


def test_pii_awkward(spark):
    texts = [(d, t) for d, t in AWKWARD if d not in (6, None)] + [
        (40, "a@b.c.@d.e x@y..z q@r.s-t.u- @a.b a@@b.c"), (41, "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.003.004 1.2.3. 999999999999999999999.1.1.1"),
        (42, "4111 1111 1111 1111 4111-1111-1111-1111x 4111  1111 1111 1111 12-34 5"), (43, "4111111111111111 - 5500005555555559 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"),
        (44, "+1 (836) 555-9331 4913187196670932 53.121.55.90"), (45, "+12 345.678-90 12 +1+2 (3)4 +1234567890123456 +1 2 3 4 5 6 7 8 9 0."),
        (46, "你 a@b.cd \U0001f600 +4915112345678 é 4111111111111111")]
    rows = by_id(pii.scan_documents(awkward(spark, texts)).withColumnRenamed("base_spans", "base"))
    check_pii([rows[d] for d, _ in texts], texts)
    assert len(pii.scan_documents(awkward(spark)).collect()) == len(AWKWARD)
    assert pii.scan_documents(empty(spark)).collect() == []


# ---------------------------------------------------------------- 8
def test_decontamination(spark, sf_small, docs):
    items = [(r["item_id"], re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    got = by_id(Q["op8_benchmark_decontamination"](spark, sf_small))
    for d, t in docs:
        w = " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
        assert set(got[d]["items"]) == {i for i, x in items if " " + " ".join(x) + " " in w}, d


# ---------------------------------------------------------------- 9
def test_quality_rules(spark, sf_small, docs):
    got = by_id(Q["op9_quality_rules"](spark, sf_small))
    for d, t in docs:
        r, want = got[d], brute.rule_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, d
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_awkward(spark):
    texts = [(d, t) for d, t in AWKWARD if d not in (6, None)]
    got = by_id(quality_rules.judge(awkward(spark, texts)))
    for d, t in texts:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.rule_counts(t), d
    assert len(quality_rules.judge(awkward(spark)).collect()) == len(AWKWARD)
    assert quality_rules.judge(empty(spark)).collect() == []
