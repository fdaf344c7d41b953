import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cribble.functions.lexicon import (
    Lexicons,
    LexiconTooLarge,
    count_matches,
    final_score,
    lexicon_score,
    matched_terms,
)
from cribble.operators.lexhits import gram_join_hits, lexicon_hits
from cribble.settings import STRONG_MARKERS

NAMES = ("lb", "msa", "egy", "gulf", "sy", "strong_lb_hits")


def lists(**given):
    return Lexicons.from_lists({n: given.get(n, []) for n in NAMES})


def counts(spark, texts, lex, plan, name="lb"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", count_matches("text", lex, plan)[name].alias("n")).orderBy("i").collect()
    return [r.n for r in rows]


@pytest.mark.parametrize("plan", ["builtin", "arrow"])
def test_containment_counts_each_list_entry(spark, plan):
    lex = lists(lb=["ab", "ab", "b c", "Zed", "عم "])
    texts = ["", None, "xaby", "ab c", "zed Zed", "هو عم", "هو عم يحكي", "AB"]
    assert counts(spark, texts, lex, plan) == [0, 0, 2, 3, 0, 0, 1, 2]


@pytest.mark.parametrize("plan", ["builtin", "arrow"])
def test_empty_entry_is_in_every_text(spark, plan):
    assert counts(spark, ["", "x", None], lists(lb=["", "x"]), plan) == [1, 2, 1]
    assert counts(spark, ["", "x"], lists(lb=["", ""]), plan) == [2, 2]


@pytest.mark.parametrize("plan", ["builtin", "arrow"])
def test_no_entries_at_all(spark, plan):
    assert counts(spark, ["a", ""], lists(), plan) == [0, 0]


@pytest.mark.parametrize("plan", ["builtin", "arrow"])
def test_against_brute_force(spark, plan):
    rng = random.Random(5)
    terms = ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    texts = ["".join(rng.choice("ABCabc éÉ\n") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    expected = [sum(1 for w in terms if w in t.lower()) for t in texts]
    assert counts(spark, texts, lists(lb=terms), plan) == expected


def test_one_more_entry_adds_exactly_its_hits(spark):
    texts = ["le la", "la", "xx"]
    once = counts(spark, texts, lists(lb=["le", "la"]), "builtin")
    twice = counts(spark, texts, lists(lb=["le", "la", "la"]), "builtin")
    assert [b - a for a, b in zip(once, twice)] == [1, 1, 0]


def test_strong_markers_as_shipped(spark):
    lex = Lexicons.from_lists({"strong_lb_hits": STRONG_MARKERS})
    assert len(STRONG_MARKERS) == len(set(STRONG_MARKERS)) == 27
    # "كتير " also contains "كتير"; a text that ends in "عم" lacks its blank.
    got = counts(spark, ["شو كتير حلو", "شو كتير", "عم", "عم بحكي"], lex, "builtin", "strong_lb_hits")
    assert got == [3, 2, 0, 1]


def score(spark, lb=0, msa=0, egy=0, gulf=0, sy=0):
    given = dict(lb=lb, msa=msa, egy=egy, gulf=gulf, sy=sy)
    words = {n: [f"<{n}{i}>" for i in range(k)] for n, k in given.items()}
    text = "".join(w for ws in words.values() for w in ws)
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(lexicon_score("text", lists(**words), plan="builtin").alias("d")).first().d


def test_score_formula(spark):
    d = score(spark, lb=3, msa=1, egy=1, gulf=1, sy=1)
    assert d.raw_score == 3 * 1.8 - 1 * 0.6 - 1 * 1.0 - 1 * 1.0 - 1 * 0.5
    assert d.msa_ratio_core == 0.25
    assert d.lexicon_score == d.raw_score / 5.0


def test_no_core_words(spark):
    d = score(spark, egy=2)
    assert (d.msa_ratio_core, d.raw_score, d.lexicon_score) == (0.0, -2.0, 0.0)


def test_dominance_at_exactly_its_limit(spark):
    d = score(spark, lb=2, msa=3)
    assert d.msa_ratio_core == 0.6
    assert d.raw_score == 2 * 1.8 - 3 * 0.6 - 3 * 0.7


def test_dominance_uses_the_unrounded_ratio(spark):
    # 599/1000 rounds to itself; 1199/2000 = 0.5995 shows as 0.6 but stays below.
    d = score(spark, lb=801, msa=1199)
    assert d.msa_ratio_core == 0.6
    assert d.raw_score == pytest.approx(801 * 1.8 - 1199 * 0.6)


def test_clamp(spark):
    assert score(spark, lb=4).lexicon_score == 1.0
    assert score(spark, msa=1).lexicon_score == 0.0


def test_third_decimal_of_the_ratio(spark):
    assert score(spark, lb=15, msa=1).msa_ratio_core == 0.063
    assert score(spark, lb=79, msa=1).msa_ratio_core == 0.013


def test_final_score_shape(spark):
    df = spark.createDataFrame([("<a>",)], "text string")
    f = df.select(final_score("text", lists(lb=["<a>"])).alias("f")).first().f
    assert f.final_score == f.lex_score == f.lexicon_details.lexicon_score == 1.8 / 5
    assert f.adi is None


def test_missing_and_other_lists(spark):
    lex = Lexicons.from_lists({"other": ["x"], "lb": ["y", "y"]})
    assert lex.select(["lb", "sy"]) == Lexicons(("lb", "sy"), (("y", (2, 0)),))
    d = spark.createDataFrame([("xy",)], "text string").select(lexicon_score("text", lex).alias("d")).first().d
    assert (d.lb, d.sy, d.strong_lb_hits, d.raw_score) == (2, 0, 0, 3.6)


def test_table_round_trip_and_size_check(spark):
    rows = [("lb", "a"), ("lb", "a"), ("msa", "a"), ("msa", "b")]
    table = spark.createDataFrame(rows, "lexicon string, term string")
    assert Lexicons.from_table(table, ["lb", "msa"]) == Lexicons.from_lists(
        {"lb": ["a", "a"], "msa": ["a", "b"]})
    with pytest.raises(LexiconTooLarge):
        Lexicons.from_table(table, max_terms=2)


@pytest.mark.parametrize("plan", ["builtin", "arrow"])
def test_matched_terms(spark, plan):
    df = spark.createDataFrame([("abc",), (None,)], "text string")
    lex = Lexicons.from_lists({"x": ["b", "bc", "zz"], "y": ["b"]})
    got = [sorted(r[0]) for r in df.select(matched_terms("text", lex, plan)).collect()]
    assert got == [["b", "bc"], []]


def test_hits_by_join_equal_hits_in_plan(spark):
    rng = random.Random(11)
    terms = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    terms += ["same prefix " + t for t in terms[:30]]
    texts = ["".join(rng.choice("ABcd ") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    texts += [t + " " + w for t, w in zip(texts, terms[-30:])]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame([("l%d" % (i % 3), t) for i, t in enumerate(terms)],
                                  "lexicon string, term string")
    counted = table.groupBy("lexicon", "term").agg(F.count(F.lit(1)).alias("multiplicity"))
    expected = {
        (i, r.lexicon, r.term, r.multiplicity)
        for r in counted.collect() for i, t in enumerate(texts) if r.term in t.lower()
    }
    assert {tuple(r) for r in lexicon_hits(items, table).collect()} == expected
    joined = [tuple(r) for r in gram_join_hits(items, counted).collect()]
    assert len(joined) == len(set(joined)) and set(joined) == expected


def test_executors_need_no_copy_of_the_package():
    from pyspark import cloudpickle

    from cribble.functions.lexicon import _matcher_builder

    payload = cloudpickle.dumps(_matcher_builder(lists(lb=["a", "b"]))).hex()
    code = "import pickle, sys; print(pickle.loads(bytes.fromhex(sys.argv[1]))()('xax'))"
    done = subprocess.run([sys.executable, "-c", code, payload], cwd="/", capture_output=True, text=True)
    assert done.stdout.strip() == "{0}", done.stderr


def random_lists(seed, n=60):
    rng = random.Random(seed)
    terms = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 6))) for _ in range(n)]
    texts = ["".join(rng.choice("ABc ") for _ in range(rng.randint(0, 90))) for _ in range(40)] + [None]
    return {"x": terms[: n // 2], "y": terms[n // 3:]}, texts


@pytest.mark.parametrize("part, kept, held", [(7, 2, 50), (7, 2, 1 << 20), (7, 99, 50), (1, 1, 1)])
def test_lists_cut_into_several_automata(spark, monkeypatch, part, kept, held):
    from cribble.functions import lexicon as X

    for name, value in (("PART_TERMS", part), ("KEPT_PARTS", kept), ("HELD_CHARS", held)):
        monkeypatch.setattr(X, name, value)
    words, texts = random_lists(5)
    lex = Lexicons.from_lists(words)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    got = df.select("id", count_matches("text", lex, "arrow").alias("c"), matched_terms("text", lex, "arrow").alias("m")).collect()
    for r in got:
        low = (texts[r.id] or "").lower()
        assert tuple(r.c) == tuple(sum(w in low for w in words[k]) for k in ("x", "y"))
        assert sorted(r.m) == sorted({w for ws in words.values() for w in ws if w in low})


def test_three_hundred_thousand_terms(spark):
    from cribble.operators.lexhits import count_matches_table

    # Numbers in base 7, each listed once or twice, and texts that hold some of them.
    digits = lambda i: "".join("abcdefg"[i // 7**k % 7] for k in range(7))
    terms = {digits(i): 1 + (i % 5 == 0) for i in range(0, 600_000, 2)}
    table = spark.createDataFrame([("lb" if i % 3 else "msa", t) for i, (t, n) in enumerate(terms.items()) for _ in range(n)],
                                  "lexicon string, term string").repartition(8)
    texts = [" ".join(digits(j * 7919 % 823_543) for j in range(i, i + 30)) * 2 for i in range(40)] + ["", None]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    name = {t: "lb" if i % 3 else "msa" for i, t in enumerate(terms)}
    expected = {}
    for i, text in enumerate(texts):
        windows = {(text or "")[k:k + 7] for k in range(len(text or "") - 6)}
        expected[i] = tuple(sum(terms[w] for w in windows if name.get(w) == x) for x in ("lb", "msa", "sy"))
    assert sum(map(sum, expected.values())) > 500
    for limit in (None, 1_000):  # by automata, by the filtered join
        got = count_matches_table(items, table, ["lb", "msa", "sy"], max_terms=limit)
        assert {r.id: tuple(r.counts) for r in got.collect()} == expected


def test_join_of_long_terms_and_long_texts(spark, monkeypatch):
    from cribble.operators import lexhits as X

    monkeypatch.setattr(X, "SLICE", 16)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abÄ漢🙂") for _ in range(n)) for n in (0, 1, 15, 16, 17, 60, 300)] + [None]
    low = [(t or "").lower() for t in texts]
    terms = {low[i][a:a + n] for i in range(len(low)) for n in (0, 1, 3, 15, 16, 17, 18, 40) for a in range(0, max(1, len(low[i]) - n), 5)}
    terms |= {"a" * 16, "a" * 17, "zz", low[5] + "x", low[4][:16] + "q"}
    table = spark.createDataFrame([("l", t) for t in terms] + [("m", ""), ("m", "a"), ("m", "a")], "lexicon string, term string")
    items = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "key string, text string")
    got = [tuple(r) for r in gram_join_hits(items, X.count_terms(table), "key").collect()]
    expected = {(f"k{i}", "l", t, 1) for i in range(len(low)) for t in terms if t in low[i]}
    expected |= {(f"k{i}", "m", "", 1) for i in range(len(low))} | {(f"k{i}", "m", "a", 2) for i in range(len(low)) if "a" in low[i]}
    assert len(got) == len(set(got)) and set(got) == expected


def test_join_without_terms_or_items(spark):
    from cribble.operators.lexhits import count_terms

    none = spark.createDataFrame([], "lexicon string, term string")
    items = spark.createDataFrame([(1, "a")], "id long, text string")
    assert gram_join_hits(items, count_terms(none)).count() == 0
    assert gram_join_hits(items.limit(0), count_terms(spark.createDataFrame([("x", "a")], none.schema))).count() == 0


def test_texts_and_grams_stay_out_of_the_shuffle(spark):
    from cribble.operators.lexhits import count_terms

    items = spark.range(100).selectExpr("id", "repeat('wort ', 50) AS text")
    table = spark.createDataFrame([("x", "wort"), ("x", "nie")], "lexicon string, term string")
    joined = gram_join_hits(items, count_terms(table))
    assert joined.count() == 100
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert not any("low" in line for line in plan.splitlines() if "Exchange" in line)


def test_strong_markers_fill_in_for_a_missing_list():
    from cribble.settings import STRONG_MARKERS

    own = lists(lb=["a", "a"], strong_lb_hits=["b"])
    assert own.with_markers() is own
    filled = Lexicons.from_lists({"lb": ["a", "a"]}).with_markers()
    assert filled == Lexicons.from_lists({"lb": ["a", "a"], "strong_lb_hits": STRONG_MARKERS})


def test_hits_of_a_batch_leave_in_pieces(monkeypatch):
    from cribble.operators import lexhits as X

    texts = [f"ab cd {i} " * 40 for i in range(3_000)] + ["", "ab" * 30_000 + "cd"]
    monkeypatch.setattr(X, "SLICE", 1 << 12)
    found = np.zeros(X.MIN_BITS // 8, np.uint8)
    for batch in X._filter_of(X.MIN_BITS)(iter([pa.RecordBatch.from_arrays([pa.array(["ab", "cd"])], names=["term"])])):
        found |= np.frombuffer(batch.column("bits")[0].as_py(), np.uint8)
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "low"])
    got = list(X._scanner(found.tobytes(), [2])(iter([whole])))
    assert max(len(b) for b in got) <= 100
    rows = sorted((r["id"], r["term"]) for b in got for r in b.to_pylist())
    assert rows == sorted((i, w) for i, t in enumerate(texts) for w in ("ab", "cd") if w in t)


def test_matches_are_added_up_few_texts_at_a_time(spark):
    import cribble.functions.lexicon as L

    lex = Lexicons.from_lists({"lb": ["a", "b"], "msa": ["a"]})
    texts, seen = pa.array(["ab", "c", "b"] * 1_000), []

    def add(total, start, matched):
        seen.append(len(matched))
        total += np.array([len(m) for m in matched])

    got = np.concatenate(list(L._in_parts(lex)(iter([texts]), lambda n: np.zeros(n, int), add, lambda total: total)))
    assert max(seen) <= L.MATCHED_ROWS and sum(seen) == len(texts)
    assert got.tolist() == [2, 0, 1] * 1_000


def test_texts_stay_in_arrow_buffers(spark):
    from pyspark.util import PythonEvalType

    lex, df = Lexicons.from_lists({"lb": ["a", "b"]}), spark.createDataFrame([("ab",)], "text string")
    for column in (count_matches("text", lex, "arrow"), matched_terms("text", lex, "arrow")):
        plan = df.select(column.alias("c"))._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"ArrowEvalPython .*, {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}\n", plan), plan
