"""Near join, passages, suffix arrays, exact substrings, top-k."""

import collections
import hashlib
import random

import numpy as np
import pytest

from plantlog.llm import exact_substrings as ex, near_join as nj, passages as ps, suffix_array as sa, topk
from plantlog.llm.components import components
from tests.llm.texts import corpus, empty, frame, words


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    low = {g: min(v, key=lambda d: (d is not None, d or 0)) for g, v in groups.items()}
    return sorted(((d, low[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("small,chunk", [(16, 512), (2, 3)])
def test_near_join_against_all_pairs(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(nj, "SMALL", small)
    monkeypatch.setattr(nj, "CHUNK", chunk)
    rows = corpus()
    got = sorted((tuple(r) for r in nj.near_join(frame(spark, rows)).select(
        "doc_id", "class_id", "n_links").collect()), key=repr)
    assert got == brute_links(rows)


def test_one_per_class(spark):
    rows = corpus()
    kept = nj.one_per_class(frame(spark, rows))
    classes = {(c,) for _, c, _ in brute_links(rows)}
    assert sorted(kept.columns) == sorted(frame(spark, rows[:1]).columns)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len(classes)
    assert nj.one_per_class(empty(spark)).count() == 0


def test_pruning_keeps_the_threshold():
    need = nj.needed_matches()
    # Pairs at the threshold lose nothing even far below their expected matches.
    assert all(need[n] < 0.8 * n - 4 * (n * 0.16) ** 0.5 for n in need) and need[nj.HASHES] > 0.5 * nj.HASHES


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (41, 50), (60, 60)]
    got = dict(components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert {got[i] for i in range(21)} == {0} and got[50] == got[41] == 40 and got[60] == 60
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def tree(values, width):
    n = len(values)
    key = [(int(x) & ~0xFFFFFF) | i for i, x in enumerate(values)]
    out = []
    for c in range(n):
        lo, hi = c, c
        while lo > 0 and key[lo - 1] > key[c]:
            lo -= 1
        while hi < n - 1 and key[hi + 1] > key[c]:
            hi += 1
        if hi - lo + 1 >= width:
            out.append((lo, c, hi))
    return out


def test_compact_windows_against_definition():
    r = np.random.default_rng(3)
    for n in (0, 6, 7, 8, 40, 90):
        for _ in range(10):
            v = r.integers(0, 1 << 63, n, dtype=np.uint64)
            assert ps.compact_windows(v, 7) == tree(v, 7)


def test_passages_show_all_verbatim_ones(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    passage = " ".join(f"shared{i}" for i in range(55))
    rows += [(400, "start " + passage + " end"), (401, " ".join(f"o{i}" for i in range(30)) + " " + passage),
             (402, " ".join(f"lonely{i}" for i in range(90)))]
    got = ps.passages(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    where = collections.defaultdict(set)
    texts = collections.defaultdict(list)
    for k, (d, t) in enumerate(rows):
        texts[d].append(words(t))
        for i in range(len(words(t)) - 49):
            where[tuple(words(t)[i:i + 50])].add(k)
    for r in got:
        have = {i for p in r.passages for i in range(p.start, p.end)}
        w = texts[r.doc_id][0]
        want = {j for i in range(len(w) - 49) if len(where[tuple(w[i:i + 50])]) > 1 for j in range(i, i + 50)}
        assert want <= have, r.doc_id
        assert r.n_dup_words == len(have)
    by = {r.doc_id: r for r in got}
    assert by[402].n_passages == 0 and by[402].class_id == 402 and by[400].class_id == by[401].class_id == 400
    assert ps.passages(empty(spark)).count() == 0


def spans_of(rows):
    return {r.doc_id: {i for p in r.passages for i in range(p.start, p.end)} for r in rows}


def hold(got, want):
    """All words; at the ends, stretches with up to five foreign shingles are near too."""
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert w <= got[d] <= {i + j for i in w for j in range(-5, 6)}, d


def made(r, n):
    return [f"{r.choice('bcdfg')}{r.randrange(10 ** 6)}" for _ in range(n)]


def test_passages_do_not_depend_on_the_shortest_text(spark):
    """Every word of every verbatim passage, also where the group's shortest text has a part of it only."""
    r = random.Random(8)
    rows, want = [], {}
    for g in range(12):
        shared = made(r, 60)
        rows.append((1000 + g, " ".join(made(r, 12) + shared[15:45] + made(r, 12))))
        rows.append((2000 + g, " ".join(made(r, 5) + shared[:52] + made(r, 5))))
        for i in range(3):
            rows.append((10 * g + i, " ".join(made(r, 70 + i) + shared + made(r, 70))))
            want[10 * g + i] = set(range(70 + i, 130 + i))
        want[2000 + g], want[1000 + g] = set(range(5, 57)), set()
    hold(spans_of(ps.passages(frame(spark, rows)).collect()), want)


def test_passages_at_several_places_of_one_text(spark):
    r = random.Random(9)
    shared = made(r, 60)
    rows = [(1, " ".join(shared + made(r, 9) + shared)), (2, " ".join(made(r, 90) + shared + made(r, 90))),
            (3, " ".join(made(r, 95) + shared + made(r, 9) + shared + made(r, 90)))]
    hold(spans_of(ps.passages(frame(spark, rows)).collect()), {
        1: {*range(60), *range(69, 129)}, 2: {*range(90, 150)}, 3: {*range(95, 155), *range(164, 224)}})


def test_near_passages_are_all_found(spark):
    """One changed, left out or added word in 50, at every place, and two at the ends."""
    r = random.Random(10)
    rows, n = [], 0
    for at in range(50):
        for kind in range(4):
            one = made(r, 50)
            two = list(one)
            if kind == 0:
                two[at] = "changed"
            elif kind == 1:
                two.insert(at, "added")
            elif kind == 2:
                del two[at]
            else:
                two[0], two[-2] = "first", "last"
            rows += [(2 * n, " ".join(made(r, 30) + one + made(r, 30))), (2 * n + 1, " ".join(made(r, 41) + two + made(r, 30)))]
            n += 1
    got = {x.doc_id: x.class_id for x in ps.passages(frame(spark, rows)).collect()}
    assert got == {i: i & ~1 for i in range(2 * n)}


def test_stretches_that_repeat_use_all_bands(spark):
    r = random.Random(11)
    rows = []
    for n in range(60):
        part = made(r, 12)
        one = made(r, 8) + part + made(r, 9) + part[:4] + made(r, 17)
        two = list(one)
        two[23] = "changed"
        rows += [(2 * n, " ".join(made(r, 30) + one + made(r, 30))), (2 * n + 1, " ".join(made(r, 41) + two + made(r, 30)))]
    got = {x.doc_id: x.class_id for x in ps.passages(frame(spark, rows)).collect()}
    assert got == {i: i & ~1 for i in range(120)}


def near_words(rows):
    """By all pairs of stretches of all texts: classes, and the words in near stretches of other texts."""
    sets = []
    for _, t in rows:
        w = words(t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        sets.append([frozenset(grams[i:i + 46]) for i in range(len(w) - 49)])
    have, root = [set() for _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(set)
    for k, all_ in enumerate(sets):
        for s in set(all_):
            for g in s:
                holders[g].add(k)
    for x, mine in enumerate(sets):
        others = {y for s in mine for g in s for y in holders[g]} - {x}
        for y in others:
            for i, s in enumerate(mine):
                if any(5 * len(s & z) >= 4 * len(s | z) for z in sets[y]):
                    have[x] |= set(range(i, i + 50))
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(rows))], have


def edited(r, text, edits):
    w = list(text)
    for _ in range(edits):
        at = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[at] = made(r, 1)[0]
        elif kind == 1:
            w.insert(at, made(r, 1)[0])
        else:
            del w[at]
    return w


def test_recall_against_all_pairs(spark):
    """Small and large groups of edited passages, some with a sentence that unrelated texts share too."""
    r = random.Random(12)
    sentence, rows = made(r, 14), []
    for g in range(25):
        base = made(r, 80)
        if g % 3 == 0:
            base[20:34] = sentence
        for i in range(2 + (g % 4 == 0) * 14):
            rows.append((len(rows), " ".join(made(r, 20) + edited(r, base, r.randrange(5)) + made(r, 15))))
    rows += [(len(rows) + i, " ".join(made(r, 40) + sentence + made(r, 40))) for i in range(30)]
    classes, have = near_words(rows)
    got = {x.doc_id: x for x in ps.passages(frame(spark, rows)).collect()}
    found = {d: {i for p in x.passages for i in range(p.start, p.end)} for d, x in got.items()}
    assert all(found[d] <= have[d] for d in found)
    assert sum(len(found[d] & have[d]) for d in found) >= 0.97 * sum(map(len, have))
    linked = [d for d in found if have[d]]
    assert sum(bool(found[d]) for d in linked) >= 0.99 * len(linked)
    same = [(a, b) for a in linked for b in linked if a < b and classes[a] == classes[b]]
    assert sum(got[a].class_id == got[b].class_id for a, b in same) >= 0.97 * len(same)
    assert all(classes[a] == classes[b] for a in found for b in found if got[a].class_id == got[b].class_id)


def test_all_members_of_large_groups_meet(spark, monkeypatch):
    """Passages of a few sentences in many orders: every shingle is in many texts, and a near text, which is no
    verbatim one, is rarely near to the others of its groups."""
    r = random.Random(14)
    sentences, rows = [made(r, 8) for _ in range(5)], []
    for g in range(24):
        one = [w for _ in range(7) for w in r.choice(sentences)]
        two = list(one)
        two[r.randrange(24, 32)] = f"other{g}"
        rows += [(len(rows), " ".join(made(r, 20) + one + made(r, 20))), (len(rows) + 1, " ".join(made(r, 31) + two + made(r, 20)))]
    classes, have = near_words(rows)
    for chunk in (ps.CHUNK, 7):
        monkeypatch.setattr(ps, "CHUNK", chunk, raising=False)
        got = {x.doc_id: x for x in ps.passages(frame(spark, rows)).collect()}
        found = {d: {i for p in x.passages for i in range(p.start, p.end)} for d, x in got.items()}
        assert all(found[d] <= have[d] for d in found)
        assert all(found[d] for d in found if have[d])
        assert sum(map(len, found.values())) >= 0.97 * sum(map(len, have))
        assert [got[d].class_id for d in range(len(rows))] == classes


def test_large_blocks_against_sets():
    """Stretches and links of one group, also of rows that repeat shingles, against sets."""
    r = random.Random(15)
    for k in (3, 8, 60, 1000):
        base, rows = [r.randrange(1, k + 1) for _ in range(91)], []
        for i in range(24):
            row = [r.randrange(1, k + 1) if r.random() < .04 else v for v in base]
            if i % 3 == 2:
                row = [r.randrange(1, k + 1) for _ in row]
            row[45], ahead, n = 0, r.randrange(46), r.randrange(1, 10)
            n = min(n, ahead + 1)
            rows.append((ahead, np.array(row[45 - ahead:45 - ahead + n + 45], np.uint64)))
        text = np.arange(1, len(rows) + 1) // 2
        block = ps._Block(text, np.array([a for a, _ in rows]), [x for _, x in rows])
        every = np.arange(len(rows))
        meet = np.triu(block.candidates(every, every), 1)
        left = [p for i in every for p in block.compare(i, every[meet[i]])]
        for p in left:
            block.exact(*p)
        at = [{45 - a + s: frozenset(x[s:s + 46].tolist()) for s in range(len(x) - 45)} for a, x in rows]
        edges = []
        for i in every:
            for s in range(46):
                near = [j for j in every if text[j] != text[i] and s in at[i] and s in at[j]
                        and 9 * len(at[i][s] & at[j][s]) >= 4 * (len(at[i][s]) + len(at[j][s]))]
                assert (block.partner[i, s] in near) if near else block.partner[i, s] < 0, (k, i, s)
                edges += [(int(text[i]), int(text[j])) for j in near]
        assert all((block.label[text == a][0] == block.label[text == b][0]) for a, b in edges)
        assert all((int(text[i]), int(text[j])) in edges for i, j, _ in block.links)


def test_stretches_of_a_diagonal_against_sets():
    r = random.Random(1)
    for _ in range(60):
        k = r.choice([3, 10, 40, 1000])
        a = [r.randrange(k) for _ in range(r.randrange(40, 130))]
        b = [r.randrange(k) if r.random() < .05 else v for v in a][r.randrange(6):]
        got = {}
        for shift, lo, hi in ps.near_stretches(np.array(a, np.uint64), np.array(b, np.uint64), list(range(-8, 9))):
            got.setdefault(shift, set()).update(range(lo, hi + 1))
        for shift in range(-8, 9):
            want = set()
            for i in range(max(0, -shift), min(len(a), len(b) - shift) - 45):
                x, y = set(a[i:i + 46]), set(b[i + shift:i + shift + 46])
                if 5 * len(x & y) >= 4 * len(x | y):
                    want.add(i)
            assert got.get(shift, set()) == want


def test_defined_results_of_passages(spark):
    r = random.Random(2)
    one, hot = " ".join(made(r, 60)), " ".join(made(r, 55))
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, one), (4, one), (None, one), (5, "x " * 3000), (6, "x " * 2500),
            (7, "ab cd " * 400), (None, None)] + [(100 + i, " ".join(made(r, 30)) + " " + hot) for i in range(40)]
    got = ps.passages(frame(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert [by[i].n_passages for i in (1, 2, 3, 4, 5, 6, 7)] == [0, 0, 0, 1, 1, 1, 0]
    assert by[4].class_id == 4 and by[5].class_id == by[6].class_id == 5 and by[3].class_id == 3
    assert {x.class_id for x in got if x.doc_id is None} == {None, 4}
    assert all(by[100 + i].class_id == 100 and by[100 + i].n_dup_words >= 55 for i in range(40))


@pytest.mark.parametrize("buckets", [0, 1024])
def test_suffix_array_against_sorting(monkeypatch, buckets):
    monkeypatch.setattr(sa, "BUCKETS", buckets)
    r = random.Random(1)
    for _ in range(150):
        k, n = r.choice([1, 2, 3, 10]), r.randrange(60)
        b = [r.randrange(k) + 1 for _ in range(n)]
        b = (b[:r.randint(1, n)] * 9)[:60] if n and r.random() < 0.4 else b
        s = np.array([*b, 0])
        got = sa.suffix_array(s, k + 1)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert got.tolist() == want
        common = sa.permuted_lcp(s, got)
        for x, y in zip(want, want[1:]):
            n = next(i for i in range(len(s)) if x + i >= len(s) or y + i >= len(s) or s[x + i] != s[y + i])
            assert common[y] == n


def brute_cut(rows, length=400):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(b[i:i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        spans = []
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        kept, end = b"", 0
        for a, e in spans:
            kept, end = kept + b[end:a], e
        kept += b[end:]
        out.append((d, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"WIDE": 2, "HOT": 4, "SHARD_BYTES": 3000}, {"_PIECE": 1500}])
def test_exact_substrings_against_counting(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ex, name, value)
    rows = corpus()
    rows += [(300, "é" * 700), (301, "xé" * 350), (302, rows[0][1][:399]), (303, rows[3][1] * 2)]
    got = ex.dedup(frame(spark, rows)).drop("spans")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_cut(rows)


def test_exact_substrings_empty(spark):
    assert ex.dedup(empty(spark)).count() == 0


def test_topk_ties_repeats_and_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 0.25, 0.5, 1.5]) for _ in range(3)]) for i in range(120)]
    rows += [(100, rows[100][1]), (50, [9.0, 9.0, 9.0]), (150, None), (200, [1.0, None, 2.0]), (250, [float("nan"), 1.0, 1.0]),
             (300, []), (350, [1.0, 2.0]), (None, [5.0, 5.0, 5.0]), (400, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(good):
        if i % 50 == 0:
            s = sorted((-max(-(1 << 63) + 1, min((1 << 63) - 1, sum(x * y for x, y in zip(v, w)))), j)
                       for b, (j, w) in enumerate(good) if b != a and len(w) == len(v))[:5]
            want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_of_the_largest_doubles(spark):
    rows = [(50, [1e307, 1.0]), (1, [1.7e308, -1.0]), (2, [-1e300, 0.0]), (3, [2.0 ** -1060, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    top = (1 << 63) - 1
    assert [tuple(r) for r in sorted(got, key=lambda r: r.rank)] == [(50, 1, 1, top), (50, 2, 3, 196608), (50, 3, 2, -top)]
    assert topk.quantise(np.array([1e307, -0.3]))[0] == 256 * int(1e307) and topk.quantise(np.array([-0.3]))[0] == -77


def test_topk_small_tiles(spark, monkeypatch):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(400, 4)))],
                               "vec_id long, embedding array<float>").repartition(4)
    want = sorted(tuple(x) for x in topk.top_k(df).collect())
    for name, value in (("TILE", 16), ("BLOCK", 3), ("SHELF", 2), ("FAN", 2)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == want
