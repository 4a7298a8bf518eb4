"""Manifest: trees, proofs and foldings against a plain recursion."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from plantlog.llm import manifest
from tests.llm.texts import empty


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, place):
    """(root, siblings on the way) of one node, by the definition."""
    way = []
    while len(nodes) > 1:
        run = place // 2 * 2
        way.append((nodes[run:place], nodes[place + 1:run + 2]))
        nodes, place = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)], place // 2
    return nodes[0], way


def expected(rows, touched):
    leaves = [(r, h(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))) for r in rows]
    groups = {}
    for r, leaf in sorted(leaves, key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1])):
        groups.setdefault(r["lang"], []).append((r, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots = [climb([x for _, x in groups[g]], 0)[0] for g in names]
    out = []
    for i, g in enumerate(names):
        for j, (r, leaf) in enumerate(groups[g]):
            way = climb([x for _, x in groups[g]], j)[1] + climb(subroots, i)[1]
            value = leaf
            if touched(r):
                value = h(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"] + 1, r["text"])))
            for left, right in way:
                value = h(*left, value, *right)
            root = climb(subroots, 0)[0]
            out.append((r["doc_id"], leaf, subroots[i], root, h(*[s for a, b in way for s in a + b]), value, value == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos int, n int, hash string"


def run(spark, rows, touched_sql="doc_id % 3 = 0 AND n_chars IS NOT NULL"):
    docs = spark.createDataFrame([(*[r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")], "g", 1, 2, "h")
                                  for r in rows], SCHEMA).repartition(3)
    got = manifest.manifest(docs, deep=2, changed=F.expr(touched_sql), changes={"n_chars": F.col("n_chars") + 1})
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
                   for r in got.collect()), key=repr)


def table(n, langs, seed=0):
    r = random.Random(seed)
    return [{"doc_id": i if r.random() > .05 else None, "source": r.choice(["a", None]), "lang": r.choice(langs),
             "n_chars": r.choice([None, 5, 7]), "text": r.choice([None, "", "é漢", "x" * 50]) and f"t{i}"} for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["x"]), (2, ["x", None]), (9, ["x"]), (70, [None, "", "b", "a", "é", "𐀀", "ﬀ"]), (33, [None])])
def test_manifest_equals_the_definition(spark, n, langs):
    rows = table(n, langs)
    rows += [dict(rows[0])] * 2
    touched = lambda r: r["doc_id"] is not None and r["doc_id"] % 3 == 0 and r["n_chars"] is not None
    assert run(spark, rows) == expected(rows, touched)


def test_parents_fold_from_the_state_before_the_slot():
    p = manifest.Parent([b"a" * 64, b"b" * 64])
    assert p.digest.decode() == h("a" * 64, "b" * 64)
    assert p.fold(0, b"c" * 64).decode() == h("c" * 64, "b" * 64)
    assert p.fold(1, b"c" * 64).decode() == h("a" * 64, "c" * 64)
    assert manifest.Parent([b"a" * 64]).digest.decode() == h("a" * 64)


def test_empty_table(spark):
    assert manifest.manifest(empty(spark)).count() == 0


def test_registered_query_tampers_by_crc(spark):
    from plantlog.llm.queries import QUERIES
    from tests.llm.texts import SF
    for r in QUERIES["op11_manifest"](spark, SF).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
