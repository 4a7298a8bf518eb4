"""Quality rules, personal data, licences, toxicity."""

import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest

from plantlog.llm import licences, pii, queries, toxicity
from plantlog.llm.quality_rules import apply_rules
from tests.llm.texts import SF, corpus, empty, frame, words
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, con, name):
    assert compare(spark, con, queries.QUERIES[name], queries.ORACLE[name], SF) is None


def repeated(w):
    n = len(w) - 7
    grams = [tuple(w[i:i + 8]) for i in range(max(0, n))]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
    return len(hit)


def test_quality_against_loops(spark):
    rows = [r for r in corpus(n=20) if len(words(r[1])) < 400]
    lines = "Home | About | Login | Help\nThis is a full sentence of the text.\nThis is a full sentence of the text."
    rows += [(300, lines), (301, "BUY!! NOW!! " * 20), (302, "word " * 19), (303, "é good line here. " * 9)]
    got = apply_rules(frame(spark, rows)).select("row.doc_id", "row.text", "row.pii", "quality.*").collect()
    assert len(got) == len(rows)
    for r in got:
        w, seen = words(r.text), set()
        full = [x for x in (r.text or "").split("\n") if words(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert r.n_dup_lines == len(full) - len(set(full))
        assert r.n_repeat_words == repeated(w)
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w))
        assert not (r.base_failed and r.kept) and r.pii == "p"
        seen.update(full)
    by = {r.doc_id: r for r in got}
    assert by[300].clean_text == "This is a full sentence of the text." and by[300].n_lines_removed == 2
    assert not by[301].kept and by[202].clean_text == ""
    assert apply_rules(empty(spark)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return (sum(x[::2]) + sum(sum(divmod(2 * v, 10)) for v in x[1::2])) % 10 == 0


def base_spans(text):
    ok = {"email": lambda g, d: True, "ip": lambda g, d: all(int(p) <= 255 for p in g.split(".")),
          "card": lambda g, d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda g, d: 8 <= len(d) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "")
            if ok[k](m.group(), re.sub("[^0-9]", "", m.group()))]


TRICKY = [(1, "a@b.c_d@e.f x@y..z q@w.com. +1 (017) 555-7713"), (2, "a@b.c.d@e.f.g 1.2.3.4.5.6.7.8 256.1.1.1 4539578763621486"),
          (3, "ééé😀 a@b.co 🎉 +49 30 1234567 and 4539-5787-6362-1486 x"), (4, "a" * 100_000), (5, "1 " * 10_000),
          (6, "x@" + "a." * 20_000 + "b"), (7, "+1+1+1(("), (8, "@a.b a@ a@b a@b. a@b.c, A@-.- 00001.2.3.0255 1..2.3.4"),
          (9, None), (10, ""), (10, ""), (11, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" mail a@b.org')]


def test_base_spans_against_python(spark):
    got = pii.find(frame(spark, TRICKY)).selectExpr("doc_id", "text", "pii").collect()
    for r in got:
        have = [f"{pii.NAMES[s.kind]}:{s.start}:{s.end}" for s in r.pii.base]
        assert have == base_spans(r.text), r.doc_id
        assert all(s in r.pii.spans for s in r.pii.base)
    assert pii.find(empty(spark)).count() == 0


def test_query_digest_is_of_base_spans(spark):
    texts = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        texts.setdefault(r.doc_id, set()).add(hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest())
    for r in queries.op1_pii(spark, SF).collect():
        assert r.base_sha256 in texts[r.doc_id]


def test_estimates_follow_votes():
    votes = lambda *v: {f"v{j}": x for j, x in enumerate(v)}
    rest = {"kind": 4, "size": 3, "prev": 0, "next": 0}
    patterns = [votes(1, 1, 1, 1, 1) | rest | {"count": 80}, votes(-1, -1, 0, -1, -1) | rest | {"count": 60, "size": 0},
                votes(1, 1, -1, 1, 1) | rest | {"count": 20}]
    _, post = pii.estimate(patterns)
    assert post[0] > 0.9 and post[2] > 0.8 and post[1] < 0.2
    model = pii.fit(patterns)
    w = dict(zip(pii.FEATURES, model.weights))
    assert w["size", 3] > w["size", 0]


def test_plan_has_no_python(spark):
    df = queries.op1_pii(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_redaction_joins_overlaps(spark):
    df = spark.sql("SELECT 'mail a@b.co now' t, array(named_struct('kind', 0, 'start', 5, 'end', 11), "
                   "named_struct('kind', 4, 'start', 7, 'end', 11)) s")
    from pyspark.sql import functions as F
    assert df.select(pii.redact(F.col("t"), F.col("s"))).first()[0] == "mail [EMAIL] now"


def test_licence_variants(spark):
    mit = licences.KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("\n", "  ")), (2, mit.replace('"', "“") + "!"),
            (3, mit + " and more"), (4, None), (5, ""), (6, "© 2001 X"), (7, "text\nLICENCED under cc by-nc 4.0\nmore")]
    got = {r.doc_id: r for r in licences.scan_lines(frame(spark, rows)).collect()}
    assert got[1].licence == got[2].licence == "MIT" and got[1].text_digest == got[2].text_digest
    assert [got[i].licence for i in (3, 4, 5, 6)] == [None] * 4 and got[6].text_digest is None
    assert got[7].notices == "CC-BY-NC-4.0 notice"
    kept = licences.scan(frame(spark, rows))
    assert kept.where("licence = 'MIT'").count() == 2 and "pii" in kept.columns
    assert licences.scan_lines(empty(spark)).count() == 0


def test_whole_licence_files(spark):
    mit, isc = licences.KNOWN["MIT"], licences.KNOWN["ISC"]
    folder = Path(licences.__file__).parent / "licence_texts"
    files = sorted(licences.FILES.items())
    bsd = (folder / "BSD.txt").read_text()
    rows = [(i, (folder / f"{f}.txt").read_text()) for i, (f, _) in enumerate(files)]
    rows += [(100, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit),
             (101, "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit),
             (102, "ISC License\n\nCopyright 2020 Some One\n\n" + isc),
             (103, "BSD 3-Clause License\n\n" + bsd), (104, "My License\n" + mit)]
    got = {r.doc_id: r.licence for r in licences.scan(frame(spark, rows)).collect()}
    assert got == {i: name for i, (_, name) in enumerate(files)} | {
        100: "MIT", 101: "MIT", 102: "ISC", 103: "BSD-3-Clause", 104: None}


def test_pii_of_long_and_crowded_texts(spark):
    """No cap on secrets and handles, spaced account numbers, and a cost in proportion to the text."""
    token, name = "aB3" * 60, "n" + "4x" * 40
    rows = [(1, f"key {token} end"), (2, f"by @{name} now"), (3, "acct 1 2 3 4 5 6 7 8 9 0 1 2 end"),
            (4, "1" * 300_000), (5, " ".join(str(i % 97) for i in range(60_000))), (6, " ".join(f"a{i}@b.com" for i in range(3000))),
            (7, "1." * 50_000), (8, "+1 " * 30_000)]
    docs = frame(spark, rows)
    found = {r.doc_id: {x.match for x in r.more} for r in pii._candidates(docs, "text", "c").selectExpr("doc_id", "c.more").collect()}
    assert found[1] >= {token} and found[2] >= {"@" + name} and found[3] >= {"1 2 3 4 5 6 7 8 9 0 1 2"}
    began = time.time()
    got = {r.doc_id: r.pii.base for r in pii.find(docs).select("doc_id", "pii").collect()}
    assert time.time() - began < 60
    assert len(got[6]) == 3000 and [s.start for s in got[6][:2]] == [0, 9] and len(got[7]) == 12500 and not got[8]


def test_pii_context_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    text = " ".join(f"é{i} call {i}@x{i}.org," for i in range(20))
    spans = pii._candidates(frame(spark, [(1, text)]), "text", "c").selectExpr("c.base").first().base
    assert len(spans) == 20
    for s in spans:
        assert text[s.start:s.end] == s.match and s.before == text[max(0, s.start - 24):s.start] and s.after == text[s.end:s.end + 1]


def test_operating_point_against_all_cuts():
    r = random.Random(5)
    for _ in range(100):
        n = r.randrange(2, 12)
        odds, y = [r.randrange(6) - 3.0 for _ in range(n)], [r.randrange(2) for _ in range(n)]
        w = [r.choice([1.0, 3.0]) for _ in range(n)]
        at = toxicity.operating_point(np.array(odds), np.array(y, float), np.array(w))
        if not 0 < sum(y) < n:
            assert at == 0
            continue

        def score(cut):
            taken = [o > cut for o in odds]
            hit = sum(b for t, a, b in zip(taken, y, w) if t and a)
            return (1 + toxicity.RECALL ** 2) * hit / (toxicity.RECALL ** 2 * sum(b for a, b in zip(y, w) if a) + sum(
                b for t, b in zip(taken, w) if t) or 1)
        assert score(at) == pytest.approx(max(score(c) for c in [o - .25 for o in odds]))


def test_chain_feeds_earlier_odds_to_later_models():
    chain = toxicity.Chain(("a", "b"), {"x": 0}, (np.array([2.0]), np.array([1.0, -3.0])), (0.5, 0.25))
    p = chain.predict(np.array([[1.0]]))[0]
    first = 2.0 + 0.5
    assert p == pytest.approx([1 / (1 + np.exp(-first)), 1 / (1 + np.exp(-(1.0 - 3 * first + 0.25)))])


def test_linear_model_reaches_its_optimum():
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 3))
    y = (x[:, 0] + r.normal(size=200) > 0).astype(float)
    w, b = toxicity.fit_linear(x, y, np.ones(200), steps=3000)
    d = (1 / (1 + np.exp(-(x @ w + b))) - y) / 200
    assert np.abs(x.T @ d + 2e-4 * w).max() < 1e-4 and abs(d.sum()) < 1e-4


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(docs, labels.where("pmod(doc_id, 3) < 2"))
    held = docs.join(labels.where("pmod(doc_id, 3) = 2"), "doc_id")
    got = toxicity.score(held, chain).select("row.toxic", "row.lang", "p").collect()
    hits = [(r.toxic, r.p[1] >= 0.5) for r in got]
    assert sum(t == 0 and p for t, p in hits) <= 0.05 * len(hits)
    assert sum(t == 1 and p for t, p in hits) >= 0.5 * sum(t for t, _ in hits)
    assert len(chain.weights[1]) == len(chain.vocabulary) + 1


def test_toxicity_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "x " * 50_000), (3, "x"), (None, "y")])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    assert toxicity.score(docs, chain).count() == 5
    blank = toxicity.train(docs, labels.limit(0))
    assert max(r.p[1] for r in toxicity.score(docs, blank).collect()) < 0.01
    assert toxicity.score(empty(spark), blank).count() == 0
