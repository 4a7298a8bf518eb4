"""Near stretches of many groups at once."""

import random

import numpy as np
import pytest

from plantlog.llm import stretch_groups as sg


def grouped(rows, cross):
    """``Groups`` of rows (group, text, side, stretches before the minimum's, shingles)."""
    group, text, side, ahead, shingles = zip(*rows)
    return sg.Groups(*(np.array(x, np.int64) for x in (group, text, side)), np.array(cross), np.array(ahead, np.int64), np.array(
        [len(x) for x in shingles]), np.concatenate(shingles), 46)


@pytest.mark.parametrize("limit", [3, 1 << 13])
def test_groups_against_sets(monkeypatch, limit):
    """Covered stretches and linked texts, also of rows that repeat shingles and of two sides, against sets."""
    for name in ("SETS", "PAIRS", "COUNTED"):
        monkeypatch.setattr(sg, name, limit)
    r, rows = random.Random(21), []
    cross = [False, False, False, False, True]
    for g, k in enumerate((3, 8, 60, 1000, 200)):
        base = [r.randrange(1, k + 1) for _ in range(91)]
        for i in range(24):
            row = [r.randrange(1, k + 1) if r.random() < .04 * (i % 4) else v for v in base]
            if i % 3 == 2:
                row = [r.randrange(1, k + 1) for _ in row]
            ahead = r.randrange(46)
            n = min(r.randrange(1, 10), ahead + 1)
            row[45] = 0
            rows.append((g, r.randrange(30), r.randrange(1, 3) if cross[g] else 1, ahead, np.array(row[45 - ahead:90 - ahead + n], np.uint64)))
    block = grouped(rows, cross)
    covered, at = block.covered(), [(int(i), int(s - block.begin[i])) for i, s in zip(block.row, block.at)]
    sets = [(rows[i][0], rows[i][1], rows[i][2], s - rows[i][3], frozenset(rows[i][4][s:s + 46].tolist())) for i, s in at]
    edges, near, may = [], [False] * len(sets), [False] * len(sets)
    for i, (g, t, side, place, x) in enumerate(sets):
        for h, u, other, there, y in sets:
            if (g, place) == (h, there) and t != u and 5 * len(x & y) >= 4 * len(x | y):
                may[i] = True
                if not cross[g] or side != other:
                    near[i] = True
                    edges.append((t, u))
    # Rows of one side of a cross group need not meet, but may.
    assert all(a <= c <= b for a, c, b in zip(near, covered.tolist(), may)) and any(near) and not all(may)
    assert all(block.label[a] == block.label[b] for a, b in edges)
    assert all(block.label[t] == t for t in range(len(block.label)) if not any(t in e for e in edges) and not any(
        m and s[1] == t for m, s in zip(may, sets)))


def test_a_common_sentence_costs_few_pairs(monkeypatch):
    """Texts that share a sentence and nothing else: no pair of their stretches is near, and none is counted."""
    r, n, met = np.random.default_rng(5), 1500, []
    sentence = r.integers(1, 1 << 62, 10, dtype=np.uint64)
    rows = [(0, i, 1, 20, np.concatenate((r.integers(1, 1 << 62, 20, dtype=np.uint64), sentence, r.integers(
        1, 1 << 62, 36, dtype=np.uint64)))) for i in range(n)]
    # Two of them are near.
    rows[7][4][:], rows[7][4][3] = rows[400][4], 5
    plain = sg.Groups._pairs

    def counted(*args):
        for x, y in plain(*args):
            met.append(len(x))
            yield x, y
    monkeypatch.setattr(sg.Groups, "_pairs", counted)
    block = grouped(rows, [False])
    assert sum(met) <= 100 and block.label[400] == 7 and (np.delete(block.label, 400) == np.delete(np.arange(n), 400)).all()
    assert set(block.row[block.covered()].tolist()) == {7, 400}
