"""Packing: subset sums and plans against brute force, pieces against the library's own ids."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plantlog.llm import packing
from plantlog.llm.common import ByteTexts, documents
from tests.llm.texts import SF, corpus, empty, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_closest_sum_equals_brute_force():
    r = random.Random(3)
    for _ in range(300):
        counts = {r.randrange(1, 40): r.randrange(4) for _ in range(5)}
        room = r.randrange(60)
        sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))}
        got = packing.closest(counts, room)
        assert all(0 < k <= counts[n] for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)


def spread(plan, counts):
    """Pieces of a plan, one by one: (length, place, start, size, sequence, at)."""
    out = []
    for length, low, high, start, size, first, per, sequence, at, room in plan:
        for place in range(low, high):
            i = first + place - low
            out.append((length, place, start, size, sequence + i // per, at + i % per * size))
    return out


@pytest.mark.parametrize("counts", [{}, {1: 1}, {700: 9}, {1023: 5}, {512: 3, 513: 4}, {2: 2000}, {700: 1000, 330: 4},
                                    {n: n % 5 for n in range(1, 1024)}])
def test_plan_places_every_id_once_without_padding(counts):
    pieces = spread(packing.slack_plan(counts), counts)
    rest, seqs = {}, {}
    for length, place, start, size, sequence, at in pieces:
        rest.setdefault((length, place), []).append((start, size))
        seqs.setdefault(sequence, []).append((at, size))
    assert set(rest) == {(n, p) for n, c in counts.items() for p in range(c)}
    for cuts, n in [(rest, lambda k: k[0]), (seqs, lambda k: None)]:
        for key, spans in cuts.items():
            end = 0
            for a, size in sorted(spans):
                assert a == end and size > 0
                end += size
            assert end == n(key) if n(key) else end == 1024 or end & (end - 1) == 0
    assert sorted(seqs) == list(range(len(seqs)))
    assert sum(sum(s for _, s in v) < 1024 for v in seqs.values()) <= 10


def test_plan_does_not_grow_with_the_counts():
    assert len(packing.slack_plan({700: 10 ** 12 + 1, 399: 10 ** 11, 3: 7})) < 400
    r = random.Random(1)
    assert len(packing.slack_plan({n: r.randrange(10 ** 9) for n in range(1, 1024)})) < 20_000


ODD = [(1, None), (2, ""), (3, " "), (4, "a  b\n \t c"), (5, "é漢 😀  x  y　 z"), (6, "don't 'll  we'll"), (7, " " * 3000),
       (8, "x" * 5000), (9, "word " * 4000), (9, "word " * 4000), (10, "<|endoftext|> a <|endoftext|>"), (11, "\x00\x1c \x85 q")]


def test_pieces_equal_the_library(spark):
    rows = ODD + corpus()
    ref = Tokenizer.from_file(PATH)
    want = sorted(((i, tuple(ref.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows), key=repr)
    got = packing.pack(frame(spark, rows).repartition(3), PATH).collect()
    check(got, want)
    assert packing.pack(empty(spark), PATH).count() == 0


def check(got, want):
    ids, by_doc, seqs = {}, {}, {}
    for i, x in want:
        ids.setdefault((i, len(x)), []).append(x)
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        # Equal rows are cut each for itself; every start comes once per row.
        assert sum(r.length for r in pieces) == key[1] * len(ids[key])
        sums = {zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) for r in pieces for x in ids[key]}
        assert {r.ids_crc32 for r in pieces} <= sums
        if len(ids[key]) == 1:
            end = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == end and r.ids_crc32 == zlib.crc32(np.array(ids[key][0][end:end + r.length], "<u4").tobytes())
                end += r.length
            assert end == key[1]
    for spans in seqs.values():
        end = 0
        for at, size in sorted(spans):
            assert at == end
            end += size
        assert end == 1024 or end & (end - 1) == 0


def test_registered_query_covers_whole_texts(spark):
    docs = documents(spark, SF).select("doc_id", "text").collect()
    ref = Tokenizer.from_file(PATH)
    from plantlog.llm.queries import QUERIES
    check(QUERIES["op13_packing"](spark, SF).collect(), [
        (r.doc_id, tuple(ref.encode(r.text or "", add_special_tokens=False).ids) + (0,)) for r in docs])


def test_stretches_do_not_change_ids():
    ref, mine = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    r = random.Random(8)
    texts = ["".join(r.choice("ab 1 '.\n\té  漢 s") for _ in range(r.randrange(60))) for _ in range(400)]
    t = ByteTexts.of(x.encode() for x in texts)
    for text, got in zip(texts, mine(t.data, t.offsets)):
        assert got.tolist() == ref.encode(text, add_special_tokens=False).ids
