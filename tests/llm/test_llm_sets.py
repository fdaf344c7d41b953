"""The shingle set join against brute force."""

import random
import re

import pytest

from cribble.llm import set_join


def brute(docs, percent, width=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[i] = {tuple(w[k: k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a0, b0 = find(a), find(b)
                least[max(a0, b0)] = min(a0, b0)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("pivots, block, group", [(64, 64, 5000), (1, 4, 10), (0, 2, 3)])
@pytest.mark.parametrize("percent", [90, 80])
def test_components(spark, monkeypatch, pivots, block, group, percent):
    for name, value in (("PIVOTS", pivots), ("BLOCK", block), ("GROUP", group)):
        monkeypatch.setattr(set_join, name, value)
    rng = random.Random(pivots + percent)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 150))] for _ in range(10)]
    docs = []
    for i in range(200):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            k, kind = rng.randrange(len(words) + 1), rng.random()
            if kind < 0.4 and words:
                words[min(k, len(words) - 1)] = rng.choice(vocabulary)
            elif kind < 0.7:
                words.insert(k, rng.choice(vocabulary).upper())
            elif words:
                words.pop(min(k, len(words) - 1))
        docs.append((i * 7, " ".join(words)))
    docs += [(9001, None), (9002, ""), (9003, "a b"), (9004, "A  b"), (9005, "a"), (9006, "b a")]
    df = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    rows = set_join.similar_components(df, percent=percent).collect()
    assert {r.id: (r.n_shingles, r.component) for r in rows} == brute(docs, percent)
    filled = [r for r in rows if r.n_shingles]
    assert sum(r.representative for r in filled) == len({r.component for r in filled})


def test_distances_decide_only_what_they_show():
    import numpy as np

    # 0 and 1 are far from their common leader by as much, so only their sets can tell.
    one = lambda *x: np.array(x, np.int64)
    found = list(set_join.list_pairs(one(0, 1, 2), one(100, 100, 100), one(0, 0, 0), one(0, 1, 2), one(9, 9, 9), one(60, 60, 2), 90))
    assert [(a.tolist(), b.tolist(), s.tolist()) for a, b, s, _ in found] == [([0], [1], [False])]
    found = list(set_join.list_pairs(one(0, 1), one(100, 100), one(0, 0), one(0, 1), one(9, 9), one(4, 5), 90))
    assert found[0][2].tolist() == [True]


def test_messy_rows(messy, empty):
    rows = set_join.similar_components(messy).collect()
    assert len(rows) == 11
    assert {r.component for r in rows if r.id in (5, 6)} == {5}
    assert all(r.n_shingles == 0 and r.component == r.id and r.representative for r in rows if r.id in (None, 2, 3, 4))
    assert {r.component for r in rows if r.id == 1} == {1}
    assert set_join.similar_components(empty).count() == 0


def test_pairs_of_a_long_list_come_in_batches_of_limited_size():
    import numpy as np
    import pyarrow as pa

    n = 1_000
    column = {"token": np.ones(n), "id": np.arange(n), "n": np.full(n, 100), "pos": np.zeros(n), "comp": np.arange(n),
              "leader": np.arange(n), "far": np.zeros(n)}
    batch = pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in column.values()], list(column))
    batches = list(set_join._list_pairs(90)(iter([batch])))
    assert sum(b.num_rows for b in batches) == n * (n - 1) // 2
    assert max(b.num_rows for b in batches) <= set_join.PAIRS + set_join.BLOCK**2


@pytest.mark.parametrize("size, changed", [(40, 3), (300, 40), (2_000, 500)])
def test_sketches_never_differ_more_than_the_sets(size, changed):
    import numpy as np

    rng = np.random.default_rng(size)
    first = rng.integers(0, 2**63, size).astype(np.uint64)
    second = np.concatenate([first[changed:], rng.integers(0, 2**63, changed).astype(np.uint64)])
    text = np.repeat([0, 2], size)
    rows = [np.frombuffer(x, np.uint8) for x in set_join.sketches(text, np.concatenate([first, second]), 3)]
    assert not rows[1].any()  # a text without members
    apart = int(np.bitwise_count(rows[0] ^ rows[2]).sum())
    assert 0.5 * min(2 * changed, set_join.SKETCH / 2) < apart <= 2 * changed


def test_pairs_with_unlike_sketches_are_refused():
    import numpy as np

    one = lambda *x: np.array(x, np.int64)
    words = np.zeros((3, set_join.SKETCH // 64), np.uint64)
    words[1, 0], words[2] = 0b1111111111, 2**64 - 1  # 10 bits off, all bits off
    args = one(0, 1, 2), one(100, 100, 100), one(0, 0, 0), one(0, 1, 2), one(7, 8, 9), one(0, 0, 0), 90
    every = {(a, b) for x in set_join.list_pairs(*args) for a, b in zip(x[0].tolist(), x[1].tolist())}
    left = {(a, b) for x in set_join.list_pairs(*args, words) for a, b in zip(x[0].tolist(), x[1].tolist())}
    assert every == {(0, 1), (0, 2), (1, 2)} and left == {(0, 1)}


def test_a_list_of_near_copies_gives_fewer_pairs_than_entries():
    import numpy as np
    import pyarrow as pa

    n = 1_000
    column = {"token": np.ones(n), "id": np.arange(n), "n": np.full(n, 100), "pos": np.zeros(n), "comp": np.arange(n) // 2,
              "leader": np.arange(n), "far": np.zeros(n)}
    batch = pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in column.values()], list(column))
    table = pa.Table.from_batches(list(set_join._list_pairs(90, True)(iter([batch]))))
    assert table.num_rows == n // 2 - 1  # 124,500 with every pair
    assert {x for k in ("leader", "id") for x in np.array(table.column(k)) // 2} == set(range(n // 2))


def test_pairs_that_met_in_enough_lists_before_are_left_out():
    import numpy as np

    one = lambda *x: np.array(x, np.int64)
    prior = np.zeros((3, set_join.BEFORE), np.int64)
    prior[:, :4] = [[5, 6, 7, 8], [8, 7, 6, 5], [5, 6, 7, 9]]
    args = one(0, 1, 2), one(100, 100, 100), one(4, 4, 4), one(0, 1, 2), one(7, 8, 9), one(0, 0, 0), 90
    found = {(a, b) for x in set_join.list_pairs(*args, None, prior) for a, b in zip(x[0].tolist(), x[1].tolist())}
    assert found == {(0, 2), (1, 2)}  # 0 and 1 met four times, the others three times


@pytest.mark.parametrize("pivots", [0, 64])
def test_near_misses_hide_no_link(spark, monkeypatch, pivots):
    """Most pairs of the group just miss; what they would have joined is looked for again."""
    monkeypatch.setattr(set_join, "PIVOTS", pivots)
    rng, again = random.Random(pivots), []
    settle = set_join.settle
    monkeypatch.setattr(set_join, "settle", lambda df, name: again.append(name) or settle(df, name))
    base, docs = [f"w{k}" for k in range(200)], []
    for i in range(80):
        words = list(base)
        for k in rng.sample(range(8, 190, 6), 3):
            words[k] = f"x{rng.randrange(4)}"
        docs.append((i, " ".join(words)))
    rows = set_join.similar_components(spark.createDataFrame(docs, "id bigint, text string")).collect()
    want = brute(docs, 90)
    assert len({c for _, c in want.values()}) > 3
    assert {r.id: (r.n_shingles, r.component) for r in rows} == want
    assert "pairs_again" in again


def test_lists_hold_only_entries_that_may_pair():
    import numpy as np
    import pyarrow as pa

    rng, rows = random.Random(5), []
    for token in range(400):
        for n in sorted(rng.choice([20, 100, 104, 140, 300]) for _ in range(rng.choice([1, 2, 2, 3, 6]))):
            rows.append((token, len(rows), n, rng.randrange(1 + n // 10)))
    rows = [r for r in rows for _ in range(2 if r[1] % 7 == 0 else 1)]  # some texts are given twice
    want = {}
    for token, i, n, pos in rows:
        for t, j, m, at in rows:
            room = min(n - pos, m - at) + min(pos, at)
            if t == token and j < i and 100 * m >= 90 * n and 190 * room >= 90 * (n + m):
                want |= {(token, i): n, (token, j): m}
    found = []
    for size in (1, 2, 3, 50, len(rows)):  # wherever batches end
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k: k + size])], ["token", "id", "n", "pos"])
                   for k in range(0, len(rows), size)]
        found.append([tuple(r.values()) for b in set_join._lists(90)(iter(batches)) for r in b.to_pylist()])
    assert all(x == found[0] for x in found)
    kept = [(token, i) for token, i, *_ in found[0]]
    assert len(set(kept)) == len(kept) and set(want) <= set(kept)
    size = {i: n for _, i, n, _ in rows}
    assert all(100 * size[leader] >= 90 * n for _, _, n, _, leader in found[0])
    # An entry that nothing of its list is near in size stays out, and so does one of two without room.
    alone = np.array([[1, 1, 1, 2, 2], [0, 1, 2, 3, 4], [20, 100, 300, 100, 100], [0, 0, 0, 0, 9]])
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in alone], ["token", "id", "n", "pos"])
    assert sum(b.num_rows for b in set_join._lists(90)(iter([batch]))) == 0


def test_sets_that_share_too_few_shingles_go_no_further(spark, monkeypatch):
    """Two texts of one size that share a phrase meet in some lists, but never in as many as they have to."""
    rows, settle = {}, set_join.settle

    def counted(df, name):
        df = settle(df, name)
        rows[name] = df.count()
        return df

    monkeypatch.setattr(set_join, "settle", counted)
    docs = [(k, " ".join([f"w{k}x{j}" for j in range(100)] + [f"p{k // 2}", f"q{k // 2}", f"r{k // 2}"])) for k in range(40)]
    result = set_join.similar_components(spark.createDataFrame(docs, "id bigint, text string")).collect()
    assert {r.id: r.component for r in result} == {k: k for k in range(40)}
    assert rows["lists"] and not rows["nodes"]
