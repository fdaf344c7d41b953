import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cribble.llm import prefix_trie as P
from cribble.llm.prefix_trie import end_digests, placed, prefix_trie

SCHEMA = "id bigint, sample_idx bigint, language string, text string"


def brute(rows, ids=()):
    """Nodes and ends by walking a trie of dicts."""
    low = lambda i: float("-inf") if i is None else i
    own = {i: [] for i in ids}
    for id_, at, language, text in rows:
        own.setdefault(id_, []).append((low(at), language or "", text or ""))
    if not own:
        return [], []
    out, ends = [], []

    def walk(members, depth, parent):
        first = min(members, key=low)
        groups = {}
        for m in members:
            if len(own[m]) == depth:
                ends.append((depth, first, m))
            else:
                groups.setdefault(own[m][depth][1:], []).append(m)
        leaves, saved = (0, 0) if groups else (1, 0)
        if depth:
            saved = (len(members) - 1) * len(own[members[0]][depth - 1][2])
        for g in groups.values():
            x, y = walk(g, depth + 1, first)
            leaves, saved = leaves + x, saved + y
        out.append((first, depth, parent, len(members), len(groups), leaves, saved))
        return leaves, saved

    for id_ in own:
        own[id_].sort(key=lambda s: (s[0], s[1:]))
    walk(list(own), 0, None)
    return out, ends


def same(trie, rows, ids=()):
    nodes, ends = brute(rows, ids)
    columns = ["id", "depth", "parent_id", "n_transcripts", "n_children", "n_leaves", "saved_chars"]
    assert sorted((tuple(r) for r in trie.nodes.select(*columns).collect()), key=str) == sorted(nodes, key=str)
    assert sorted((tuple(r) for r in trie.ends.collect()), key=str) == sorted(ends, key=str)


def grown(seed, n=80, longest=14):
    """Transcripts that copy beginnings of earlier ones and part anywhere."""
    rng, past, rows = random.Random(seed), [[]], []
    for i in range(n):
        old = rng.choice(past)
        new = old[:rng.randint(0, len(old))] + [(rng.choice("ab"), rng.choice(["", "x", "yy", "漢字🙂"])) for _ in range(rng.randint(0, 5))]
        new = new[:longest]
        past.append(new)
        rows += [(i, k * 10, *turn) for k, turn in enumerate(new)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunk", [4, 4_096])
def test_equals_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(P, "CHUNK", chunk)  # one block a chunk: everything is carried over
    rows = grown(seed)
    ids = spark.range(80)
    same(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), ids), rows, range(80))


def test_hot_beginning_and_copies(spark):
    rows = [(i, k, "user", f"t{k}") for i in range(300) for k in range(6)]
    rows += [(i, 6, "user", f"own {i % 5}") for i in range(0, 300, 2)]
    same(prefix_trie(spark.createDataFrame(rows, SCHEMA)), rows)


def test_messy_rows(spark):
    rows = [(1, 0, "a", "x"), (1, None, None, None), (1, 0, "a", "x"), (None, 3, "a", "x"), (None, None, "", None),
            (2, 5, "", ""), (2, 7, "a", "x"), (3, 0, "", ""), (4, 0, "a", "x" * 300_000), (5, 0, "a", "x" * 300_000),
            (6, 0, "ax", ""), (7, 0, "a", "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS node", "2 AS n", "3 AS m", "'x' AS digest", "4 AS depth", "5 AS pos", "6 AS block").repartition(3)
    extra = spark.createDataFrame([(9,), (1,), (1,)], "id bigint").withColumn("spoken", F.lit("x"))
    same(prefix_trie(df, extra), rows, (9, 1))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(none).nodes.count() == 0 and prefix_trie(none).ends.count() == 0
    trie = prefix_trie(none, spark.range(3))
    assert [tuple(r) for r in trie.nodes.collect()] == [(0, 0, None, 3, 0, 1, 0)]
    assert sorted(tuple(r) for r in trie.ends.collect()) == [(0, 0, i) for i in range(3)]


def test_one_transcript_with_most_samples(spark):
    rows = [(7, k, "a", str(k % 3)) for k in range(5_000)] + [(8, k, "a", str(k % 3)) for k in range(4_998)] + [(1, 0, "b", "z")]
    nodes = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4)).nodes
    got = {(r.id, r.depth): r for r in nodes.collect()}
    assert len(got) == 5_002
    assert got[(7, 4_998)].n_transcripts == 2 and got[(7, 4_998)].n_leaves == 1 and got[(7, 5_000)].n_transcripts == 1
    assert got[(7, 4_097)].parent_id == 7 and got[(7, 1)].saved_chars == 4_998 and got[(1, 0)].n_leaves == 2


def test_end_digests_of_long_lists(spark):
    ends = spark.range(20_000).selectExpr("CAST(2 AS BIGINT) AS depth", "CAST(0 AS BIGINT) AS node", "id").unionByName(
        spark.createDataFrame([(1, None, None), (1, None, 5), (1, 3, 10), (1, 3, 9)], "depth bigint, node bigint, id bigint"))
    got = {(r.depth, r.node): r.ends_sha256 for r in end_digests(ends.repartition(7)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(2, 0): sha(",".join(map(str, range(20_000)))), (1, None): sha(",5"), (1, 3): sha("9,10")}


def test_places_within_ids(spark):
    rows = [(1, 9), (1, None), (1, 3), (2, 0)]
    got = placed(spark.createDataFrame(rows, "id bigint, at bigint"), ["at"]).collect()
    assert sorted((r.id, r.pos, r.m, r["at"] or -1) for r in got) == [(1, 0, 3, -1), (1, 1, 3, 3), (1, 2, 3, 9), (2, 0, 1, -1)]


def test_runs_on_nested_transcripts(spark, tmp_path):
    from cribble.sources.transcripts import flatten_samples, nest_samples, read_transcripts, write_transcripts

    rows = [(1, 0, "ar", "a"), (1, 1, "ar", "b"), (2, 0, "ar", "a"), (3, 0, "fr", "a")]
    write_transcripts(nest_samples(spark.createDataFrame(rows, SCHEMA)), str(tmp_path / "t"))
    same(prefix_trie(flatten_samples(read_transcripts(spark, str(tmp_path / "t"), multi_line=False))), rows)
