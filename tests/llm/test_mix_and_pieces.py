"""Mixing, pieces, the pipeline."""

import itertools
import random
import time

import duckdb
import pytest

import corpus_pipeline
from plantlog.llm import mixing, pieces, sql
from plantlog.llm.common import documents
from tests.llm.texts import SF, corpus, empty, frame, words


def test_mix_meets_targets(spark):
    rows = corpus(n=400)
    docs = frame(spark, rows)
    got = [r.asDict() | {"doc_id": r.row.doc_id, "source": r.row.source} for r in mixing.plan(docs).collect()]
    again = sorted((r.row.doc_id or -1, r.repeats) for r in mixing.plan(docs.repartition(7)).collect())
    assert again == sorted((r["doc_id"] or -1, r["repeats"]) for r in got)
    sizes, total = {}, 0
    for r in got:
        sizes.setdefault(r["source"], []).append(r)
        total += r["size"]
    assert sum(rs[0]["target"] for rs in sizes.values()) == pytest.approx(total)
    for rs in sizes.values():
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-6
        assert abs(sum(r["size"] * r["repeats"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
        assert all(0 <= r["repeats"] <= 3 for r in rs)
    taken = mixing.sample(docs)
    assert taken.count() == sum(r["repeats"] for r in got) and taken.columns == docs.columns
    assert mixing.plan(empty(spark)).count() == 0


@pytest.mark.parametrize("few", [100_000, 3])
def test_mix_takes_parts_of_ties_as_sql_does(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "EDGE_ROWS", few)
    text = lambda n: " ".join(["w"] * n)
    rows = [(None, text(10), s) for s in ("a", "b", None) for _ in range(100)] + [(i, text(1 + i % 7), "c") for i in range(90)]
    rows += [(5, text(4), "a")] * 7 + [(None, None, "b")] * 5 + [(None, text(3), "b")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = [(r.row.doc_id, r.row.source, r.size, r.source_size, r.target, r.size * r.repeats) for r in mixing.plan(docs).collect()]
    assert len(got) == len(rows)
    for source in ("a", "b", "c", None):
        mine = [r for r in got if r[1] == source]
        assert abs(sum(r[5] for r in mine) - mine[0][4]) <= max(r[2] for r in mine) / 2 + 1e-6
        assert all(r[5] <= 3 * r[2] for r in mine)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.execute(sql.MIXING).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(((r[0], r[2], r[3], round(r[4], 6), r[5]) for r in got), key=key) == sorted(
        ((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in want), key=key)


def test_water_filling_caps(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    # a (1) and null (2) stop at 30 and 15, d (1) at 0; b (2) and c (3) share what is left.
    assert got["a"] == 30 and got[None] == 15 and got["d"] == 0
    assert got["b"] == pytest.approx(1970 * 2 / 5) and got["c"] == pytest.approx(1970 * 3 / 5)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces()


ODD = ([(1, None), (2, ""), (3, " "), (5, " " * 47 + "漢"), (6, "a" * 300), (7, "==" * 60 + "x" * 9 + "\n\n\t def f(x):  x**2 ²."),
        (8, "é漢😀\x00 ▁▁x ▁"), (9, "don't  stop   now    or     else"), (10, "wordswithoutbreak" * 12), (10, "x")]
       + [(100 + i, " " * i + ("the" if i % 2 else "(")) for i in range(36)])


@pytest.mark.parametrize("limit", [pieces.TABLE_BYTES, 400])
def test_pieces_equal_the_library(spark, model, limit):
    docs = frame(spark, ODD).unionByName(documents(spark, SF).limit(60).select(
        "doc_id", "text", "lang", "source", "n_chars").selectExpr("*", "'r' row", "'k' key", "'p' pii"))
    got = pieces.decode(pieces.encode(docs, pieces=model, table_bytes=limit), pieces=model).collect()
    assert len(got) == len(ODD) + 60
    for r in got:
        assert r.ids == model.processor.encode(r.row.text or "")
        assert r.decoded == (r.row.text or "").replace("▁", " ")
    assert pieces.encode(empty(spark), pieces=model).count() == 0


def test_long_runs_equal_the_library_in_seconds(spark, model):
    r = random.Random(6)
    runs = ["a" * 100_000, "".join(r.choice("acgt") for _ in range(100_000)), "".join(r.choice("etaoinshrdlu") for _ in range(30_000)),
            "é漢" * 4000, " " * 5000 + "x" * 61, "".join(r.choice("abc ") for _ in range(20_000)).replace(" ", "   "), "==" * 3000, "x" * 61]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    began = time.time()
    got = pieces.encode(docs, pieces=model, decoded="back").collect()
    assert time.time() - began < 90
    for x in got:
        assert x.ids == model.processor.encode(runs[x.row.doc_id]) and x.back == runs[x.row.doc_id]


def test_queue_fold_and_best_path_against_definitions():
    r = random.Random(4)
    for _ in range(300):
        n = r.randrange(1, 14)
        edges = {i * 64 + size: r.randrange(6) for i in range(n) for size in range(2, 5) if i + size <= n and r.random() < .6}
        borders = list(range(n + 1))
        while True:
            pairs = [(edges[borders[k] * 64 + borders[k + 2] - borders[k]], k) for k in range(len(borders) - 2)
                     if borders[k] * 64 + borders[k + 2] - borders[k] in edges]
            if not pairs:
                break
            del borders[min(pairs)[1] + 1]
        assert pieces._folded(edges, n) == borders
        scores = {e: -float(v) - 1 for e, v in edges.items()}
        value = lambda b: sum(scores.get(x * 64 + y - x, -20.0) for x, y in zip(b[:-1], b[1:]))
        top = max(value([0, *cut, n]) for k in range(n) for cut in itertools.combinations(range(1, n), k)
                  if all(y - x == 1 or x * 64 + y - x in scores for x, y in zip([0, *cut], [*cut, n])))
        assert value(pieces._best_path(scores, n, 4, -20.0)) == top


def test_viterbi_of_a_unigram_table(spark):
    rows = [("▁", 1, -2.0), ("a", 2, -1.5), ("b", 3, -1.6), ("ab", 4, -2.0), ("▁a", 5, -2.2), ("ba", 6, -2.5), ("aba", 7, -4.9)]
    table = pieces.Pieces.of(rows, unk=0, bpe=False)
    texts = ["".join(t) for n in range(1, 6) for t in itertools.product("abc", repeat=n)][:150] + ["abca" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {p: s for p, _, s in rows}
    ids = {i: p for p, i, _ in rows}
    floor = min(score.values()) - 10

    def best(w):
        top = [0.0] + [float("-inf")] * len(w)
        for j in range(1, len(w) + 1):
            top[j] = max(top[i] + score.get(w[i:j], floor if j - i == 1 else float("-inf")) for i in range(j))
        return top[-1]

    for r in pieces.encode(docs, pieces=table).collect():
        value = sum(score[ids[i]] if i in ids else floor for i in r.ids)
        assert value == pytest.approx(best("▁" + r.row.text))


def test_pipeline_stages(spark):
    docs, sf = documents(spark, SF), SF
    from plantlog.llm import near_join as nj, pii
    from pyspark.sql import functions as F
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, sf), "pipeline-test")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        seen[name] = docs
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    good = documents(spark, SF).join(labels, "doc_id").collect()
    kept = {r.doc_id for r in seen["quality rules"].collect()}
    assert all(r.doc_id in kept for r in good if len(words(r.text)) >= 40)
    classes = nj.near_join(seen["near duplicates"])
    assert classes.where("n_links > 0").count() == 0
    assert pii.find(seen["personal data"]).where(F.size("pii.base") > 0).count() == 0
    ids = {r.doc_id for r in seen["source mix"].collect()}
    assert ids <= kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and out.where("n_pieces = 0").count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, texts without words, and columns that clash with inner names."""
    rows = corpus(n=12) + [(300, "mail me at a.b@example.org, call +1 212 555 0199. " * 3 + "This is a plain sentence of words. " * 4),
                           (None, None), (None, "A good sentence stands here, it has some words. " * 5)]
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.saved(stage(spark, docs, SF), "odd-stage")
        if name != "pieces":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if name == "quality rules":
            assert docs.where("text IS NULL OR text = ''").count() == 0 and 0 < docs.count() <= len(rows)
        if name == "near duplicates":
            assert docs.count() == docs.select("doc_id", "text").distinct().count() <= before.count()
        if name == "personal data":
            assert docs.count() == before.count() and docs.where("text LIKE '%example.org%'").count() == 0
        if name == "pieces":
            assert docs.count() == before.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_pipeline_stages_on_no_rows_and_null_texts(spark, name, stage):
    none = stage(spark, empty(spark), SF)
    assert none.count() == 0
    nulls = frame(spark, [(1, None), (1, None), (None, None), (2, "")])
    got = stage(spark, nulls, SF).collect()
    # Rejected by the rules; of a class of their own; unchanged; of size 0 in the mix; no pieces.
    assert len(got) == {"quality rules": 0, "near duplicates": 3, "personal data": 4}.get(name, len(got)) and len(got) <= 12
