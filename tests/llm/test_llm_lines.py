"""Shared lines, quality rules and contamination on rows that the tables do not hold."""

import random

import numpy as np

import pytest

from cribble.llm.contamination import find_contamination
from cribble.llm.line_dedup import LineIndex, PerfectHash, drop_shared_lines
from cribble.llm.quality import quality_verdicts, source_rates


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    table = PerfectHash(*keys)
    assert table.size == 5000 and sorted(table.find(*keys)) == list(range(5000))
    assert PerfectHash(keys[0][:0], keys[1][:0]).size == 0


def test_index_rejects_lines_it_does_not_hold():
    a = np.arange(100, dtype=np.int64)
    index = LineIndex(a, a * 3, np.full(100, 5), np.full(100, 7))
    assert index.dropped(a * 0, a, a * 3, 3).all()
    assert not index.dropped(a * 0 + 7, a, a * 3, 3).any()  # the holder keeps its line
    assert not index.dropped(a * 0, a + 1000, a * 3, 3).any()
    assert not index.dropped(a * 0, a, a * 3 + 1, 3).any()


def brute_lines(docs):
    from collections import defaultdict

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for row, (i, text) in enumerate(docs):  # each row counts
        for line in text.split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add((i, row))
    bad = {k: max(v)[0] for k, v in held.items() if len(v) >= 3}
    return {i: "\n".join(x for x in text.split("\n") if bad.get(key(x), i) == i) for i, text in docs}


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"line number {i:03d} " + rng.choice(["é" * 12, "ABC def ghi jkl", "x"]) for i in range(60)]
    docs = [(i * 3, "\n".join(rng.choice([str.upper, str, lambda s: f"\t{s} \r"])(rng.choice(pool)) for _ in range(rng.randint(1, 9))))
            for i in range(150)]
    df = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    want = brute_lines(docs)
    for shard_keys in (1 << 15, 4):
        got = {r.id: r.text for r in drop_shared_lines(df, shard_keys=shard_keys).collect()}
        assert got == want


def test_line_of_nearly_all_texts(spark):
    """One line in two thirds of all texts, each with lines of its own: it is looked up apart."""
    docs = [(i, "\n".join(f"a line of text {i} alone {k}" for k in range(2)) + ("\nthe very same line everywhere" if i % 3 else ""))
            for i in range(600)]
    df = spark.createDataFrame(docs, "id bigint, text string").repartition(4)
    assert {r.id: r.text for r in drop_shared_lines(df).collect()} == brute_lines(docs)


def test_lines_of_messy_rows(messy, empty):
    rows = drop_shared_lines(messy, carry=("source",)).collect()
    assert len(rows) == 11
    assert all(r.n_lines == 1 and r.n_dropped == 0 and r.text == "" for r in rows if r.id in (2, 3))
    assert sorted(str(r.carried.source) for r in rows if r.id == 7) == ["b", "b"]
    assert drop_shared_lines(empty).count() == 0


def test_source_that_mostly_fails_goes(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 else "short", "ok") for i in range(200)]
    rows += [(1000 + i, good if i % 10 == 0 else "short", "bad") for i in range(200)]
    rows += [(3000, "short", "tiny"), (3001, good, "tiny"), (3002, good, "tiny"), (4000, good, None), (4001, None, "ok")]
    df = spark.createDataFrame(rows, "id bigint, text string, source string")
    got = {r.id: r for r in quality_verdicts(df).collect()}
    assert len(got) == len(rows)
    assert got[1].kept and not got[0].kept and not got[1000].kept and got[1000].source_failed and not got[1000].base_failed
    assert got[3001].kept and got[4000].kept and not got[4001].kept
    from cribble.llm.quality import measures

    rates = {(r.source, r.rule): r.rate for r in source_rates(measures(df)).collect()}
    assert 0.1 < rates["ok", "short"] < 0.12 and 0.85 < rates["bad", "short"] < 0.9
    assert rates["tiny", "short"] > 1 / 3  # drawn towards the other sources


def test_repeats_are_counted_once_per_word(spark):
    rows = [(1, "a b c d e f a b c d e f"), (2, "x " * 8), (3, "p q r s t u"), (4, "a b c d e")]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "'s' AS source")
    assert {r.id: r.n_repeat_words for r in quality_verdicts(df).collect()} == {1: 12, 2: 8, 3: 0, 4: 0}


def test_quality_of_messy_rows(messy, empty):
    rows = quality_verdicts(messy).collect()
    assert len(rows) == 11 and all(r.base_failed and not r.kept for r in rows if r.id in (None, 2, 3, 4))
    assert quality_verdicts(empty).count() == 0


def test_contamination(spark):
    item = " ".join(f"t{i}" for i in range(20))
    items = spark.createDataFrame([(10, item), (9, "Short Phrase here"), (8, None), (7, ""), (None, "one two"), (10, item)], "item_id bigint, text string")
    filler = " ".join(f"f{i}" for i in range(100))
    docs = [(1, f"{filler} {' '.join(item.split()[2:16]).upper()} {filler}"), (2, " ".join(item.split()[:12])),
            (3, f"a short-phrase; HERE b"), (4, None), (5, ""), (6, "x one. two y"), (6, item), (None, item)]
    df = spark.createDataFrame(docs, "id bigint, text string").selectExpr("*", "0 AS n_hit", "'z' AS items").repartition(2)
    got = {(r.id, r.n_words): (r.n_hit, r["items"], r.contaminated) for r in find_contamination(df, items).collect()}
    assert got == {
        (1, 214): (14, [10], True), (2, 12): (0, [], False), (3, 5): (3, [9], True), (4, 0): (0, [], False),
        (5, 0): (0, [], False), (6, 4): (2, [], True), (6, 20): (20, [10], True), (None, 20): (20, [10], True)}
    none = find_contamination(df, items.limit(0))
    assert {(r.n_hit, r.contaminated) for r in none.collect()} == {(0, False)} and none.count() == 8
    assert find_contamination(df.limit(0), items).count() == 0


def test_contamination_beyond_the_filter(spark, monkeypatch):
    """A filter that lets much through changes nothing."""
    from cribble.llm import contamination

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(str, find_contamination(docs, items).collect()))
    monkeypatch.setattr(contamination, "MAX_FILTER_BITS", 4)
    assert sorted(map(str, find_contamination(docs, items).collect())) == want


def brute_hits(texts, items, span=13):
    """Per text: words in windows of items, and the items."""
    import re

    split = lambda t: tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(w[k: k + n], set()).add(i)
    out = []
    for i, t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if w[k: k + n] in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w[k: k + n]]
        out.append((i, len(w), len(hit), sorted(found - {None})))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_contamination_against_brute_force(spark, messy, seed):
    """Few different words, so that grams tie, recur and are shared by several items of all lengths."""
    import random

    from conftest import LONG

    rng = random.Random(seed)
    def some(n, letters="abc"):
        return " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, some(rng.choice([1, 3, 6, 7, 8, 12, 13, 14, 30]), "abcdefgh")) for i in range(12)] + [(90, "a " * 40), (91, some(20)), (91, some(9)), (None, some(16))]
    items += [(92, " ".join(LONG.split()[500:520])), (93, None)]
    texts = []
    for i in range(40):
        parts = [some(rng.randint(0, 30), "abcdefgh")]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(w))
            parts += [" ".join(w[at: at + rng.randint(5, 30)]), some(rng.randint(0, 3), "abcdefgh")]
        texts.append((i, " ".join(parts)))
    texts += [(r.id, r.text) for r in messy.collect()]
    df = spark.createDataFrame(texts, "id bigint, text string").selectExpr("*", "1 AS start", "2 AS low", "3 AS ids").repartition(3)
    got = find_contamination(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    key = lambda x: str(x)
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(brute_hits(texts, items), key=key)


def test_fingerprints_are_selected_minima():
    """Every window selects one of its grams, and far fewer grams are selected than there are words."""
    import numpy as np

    from cribble.llm.contamination import GRAM, SPAN, selected
    from cribble.llm.words import ALNUM, LOWER, Rolling, Words

    text = " ".join(f"w{i % 701}x{i % 13}" for i in range(5_000)).encode()
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ALNUM, LOWER)
    place, _ = selected(words, SPAN, Rolling(2))
    gaps = np.diff(np.concatenate(([-1], place, [5_000 - GRAM + 1])))
    assert gaps.max() <= SPAN - GRAM + 1 and len(place) < 0.35 * 5_000
