"""Suffix arrays, and both ways of removing repeated passages, against brute force."""

import random
import re

import numpy as np
import pytest

from cribble.llm import passages, phrase_dedup
from cribble.llm.phrase_dedup import remove_repeated_phrases
from cribble.llm.suffix_dedup import remove_repeated_bytes
from cribble.llm.suffixes import permuted_lcp, suffix_array


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, rng.integers(2, 5), rng.integers(1, 80))
    if seed % 3 == 0:
        text = np.tile(text[:4], 15)
    text = np.append(text, 0)
    items = text.tolist()
    want = sorted(range(len(items)), key=lambda i: items[i:])
    order = suffix_array(text)
    assert order.tolist() == want
    shared = permuted_lcp(text, order)
    for x, y in zip(want, want[1:]):
        n = 0
        while items[x + n: x + n + 1] == items[y + n: y + n + 1] != []:
            n += 1
        assert shared[y] == n


def corpus(seed, alphabet, n=90):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(400)) for _ in range(5)]
    docs = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 5)):
            kind, a = rng.random(), rng.randint(0, 200)
            if kind < 0.4:
                text += rng.choice(base)[a: a + rng.randint(0, 200)]
            elif kind < 0.5:
                text += rng.choice("ab ") * rng.randint(1, 150)
            elif kind < 0.6:
                text += base[0][: rng.randint(1, 9)] * rng.randint(2, 30)
            else:
                text += "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120)))
        docs.append((i * 37 % 1009, text))
    return docs


def brute_bytes(docs, span):
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = text.encode()
        gone = [False] * len(data)
        for k in range(len(data) - span + 1):
            if data[k: k + span] in seen:
                gone[k: k + span] = [True] * span
            seen.add(data[k: k + span])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone) if not g))
    return out


def brute_words(docs, span):
    first, out = {}, {}
    for i, text in sorted(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = [False] * len(words)
        for k in range(len(words) - span + 1):
            if first.setdefault(tuple(words[k: k + span]), i) < i:
                gone[k: k + span] = [True] * span
        out[i] = (len(words), sum(gone), " ".join(x for x, g in zip(words, gone) if not g))
    return out


@pytest.fixture(params=["usual", "all limits small", "few segments a task"])
def limits(request, monkeypatch):
    if request.param != "usual":
        small = (("WIDE", 3), ("COMBINE", 3000), ("PIECE", 700), ("SHARD", 3000), ("PART", 7))
        for name, value in small[request.param == "few segments a task":]:
            monkeypatch.setattr(passages, name, value)
        for name in ("STREAM", "MATCHES"):
            monkeypatch.setattr(phrase_dedup, name, 2)


@pytest.mark.parametrize("alphabet", ["abcdé ", "a b"])
def test_repeated_bytes(spark, limits, alphabet):
    docs = corpus(5, alphabet)
    df = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(df, span=40, gram=12).collect()}
    assert got == brute_bytes(docs, 40)


@pytest.mark.parametrize("alphabet", ["abcdé ", "a b"])
def test_repeated_phrases(spark, limits, alphabet):
    docs = [(i, " ".join(re.findall("..?.?", t))) for i, t in corpus(6, alphabet)]
    df = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    got = {r.id: (r.n_words, r.n_removed, r.text) for r in remove_repeated_phrases(df, span=10).collect()}
    assert got == brute_words(docs, 10)


def test_every_repeated_passage_is_located_by_an_automaton(spark, monkeypatch):
    """Exact copies of texts and of passages stay if the automata locate nothing."""
    rng = random.Random(9)
    some = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    same, shared = some(200), some(60)
    docs = [(i, " ".join(same if i % 3 == 0 else some(30) + shared + some(30))) for i in range(90)]
    df = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    want = brute_words(docs, 20)
    assert {r.id: (r.n_words, r.n_removed, r.text) for r in remove_repeated_phrases(df, span=20).collect()} == want
    assert sum(x[1] for x in want.values()) > 0.5 * sum(x[0] for x in want.values())
    streamed = spark.sparkContext.accumulator(0)

    def nothing(span):
        def locate(found, table):
            streamed.add(table.num_rows)
            none = np.zeros(0, np.int64)
            return passages.runs_of(none, none, none)

        return locate

    monkeypatch.setattr(phrase_dedup, "_locating", nothing)
    assert {r.n_removed for r in remove_repeated_phrases(df, span=20).collect()} == {0}
    assert streamed.value > 90


def test_bytes_of_messy_rows(messy, empty):
    rows = remove_repeated_bytes(messy).collect()
    assert len(rows) == 11
    first, second = (next(r for r in rows if r.id == i) for i in (5, 6))
    assert first.n_removed < first.n_bytes and second.n_removed == second.n_bytes - len(second.kept) > 0
    assert all(r.n_bytes == r.n_removed == r.n_spans == 0 for r in rows if r.id in (None, 2, 3))
    assert len({(r.n_bytes, bytes(r.kept)) for r in rows if r.id == 1}) == 1
    assert remove_repeated_bytes(empty).count() == 0


def test_phrases_of_messy_rows(messy, empty):
    rows = remove_repeated_phrases(messy).collect()
    assert len(rows) == 11
    by_id = {r.id: r for r in rows}
    assert by_id[5].n_removed == 0 and by_id[6].text == "Ende" or by_id[6].n_removed == 30_000
    assert by_id[4].n_words == 0 and by_id[4].text == "" and by_id[None].n_words == 0
    assert remove_repeated_phrases(empty).count() == 0


@pytest.mark.parametrize("wide", [2_000, 1])
def test_a_repeated_row_is_not_its_own_earlier_text(spark, monkeypatch, wide):
    """The repeated text shares a passage partly with a third, so its segments are compared."""
    monkeypatch.setattr(passages, "WIDE", wide)
    rng = random.Random(3)
    one, two, three, four = ("".join(rng.choice("abcdefgh") for _ in range(300)) for _ in range(4))
    docs = [(1, one + two[:150] + three), (2, two + four), (3, three[:120] + "x" + two[100:])]
    want = brute_bytes(docs, 40)
    assert want[2][1] < want[2][0] / 2
    df = spark.createDataFrame([*docs, docs[1], docs[1], docs[2]], "id bigint, text string").repartition(3)
    rows = [(r.id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in remove_repeated_bytes(df, span=40, gram=12).collect()]
    assert sorted(rows) == sorted((i, want[i]) for i in (1, 2, 2, 2, 3, 3))


@pytest.mark.parametrize("words", [False, True])
def test_a_string_shared_by_all_texts_of_a_wide_group_is_not_gathered(spark, monkeypatch, words):
    from cribble.llm import phrase_dedup, suffix_dedup

    for name, value in (("WIDE", 3), ("COMBINE", 30_000)):
        monkeypatch.setattr(passages, name, value)
    rng = random.Random(8)
    some = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    shared = some(70)
    docs = [(i, (" " if words else "").join(some(60) + shared + some(60))) for i in range(300)]
    span, module = (40, phrase_dedup) if words else (40, suffix_dedup)
    usual = module._comparing(span)

    def compare(table):
        if table.num_rows > 200:  # each text gives about 30 strings
            raise ValueError(f"{table.num_rows} segments in one shard")
        return usual(table)

    monkeypatch.setattr(module, "_comparing", lambda span: compare)
    df = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    if words:
        got = {r.id: (r.n_words, r.n_removed, r.text) for r in remove_repeated_phrases(df, span=span).collect()}
        assert got == brute_words(docs, span)
    else:
        got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(df, span=span, gram=12).collect()}
        assert got == brute_bytes(docs, span)
    assert len({x[1] for x in got.values()}) > 1


@pytest.mark.parametrize("seed", range(20))
def test_both_ways_of_inducing_give_the_same_order(seed):
    from cribble.llm.suffixes import _induce, _induce_rare, suffix_types

    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(1, rng.integers(2, 40), rng.integers(3, 300)), 0)
    smaller = suffix_types(text)
    lms = np.flatnonzero(smaller & np.append(False, ~smaller[:-1]))
    items = text.tolist()
    lms = np.array(sorted(lms.tolist(), key=lambda i: items[i:]), np.int64)
    want = sorted(range(len(items)), key=lambda i: items[i:])
    for induce in (_induce, _induce_rare):
        assert induce(text, smaller, lms, np.bincount(text)).tolist() == want


def test_every_level_of_a_long_text_is_induced(monkeypatch):
    from cribble.llm import suffixes

    levels = []
    usual = suffixes._induce_rare
    monkeypatch.setattr(suffixes, "_induce_rare", lambda text, *rest: levels.append(len(text)) or usual(text, *rest))
    rng = np.random.default_rng(4)
    base = rng.integers(1, 200, 6_000)
    text = np.concatenate([base, base[1_000:4_000], rng.integers(1, 200, 3_000), base[:2_500], [0]])
    items = text.astype(">u2").tobytes()
    want = sorted(range(len(text)), key=lambda i: items[2 * i:])
    assert suffix_array(text).tolist() == want
    assert len(set(levels)) > 1  # more than one level below, or beside, the first


def test_tiles_without_room_for_a_window_make_no_matches():
    """A phrase that thousands of passages begin with, met thousands of times where segments end."""
    import tracemalloc

    from cribble.llm.phrase_dedup import Phrases

    span, many = 50, 1_500
    common = [b"c%d" % k for k in range(30)]
    own = [[b"p%d.%d" % (p, k) for k in range(30)] for p in range(many)]
    rows = [common[p % 3:] + own[p] for p in range(many)]
    least = [np.arange(len(r) - span + 1, dtype=np.int64) + 100 * p for p, r in enumerate(rows)]
    segs = [[b"s%d.%d" % (p, k) for k in range(25)] + common for p in range(many)]
    segs += [rows[7], rows[8][1:] + [b"x"], [b"x"] * 9 + rows[11], own[5] + common + own[5], own[3][-20:] + rows[9] + common]
    of = {}
    for r, ids in zip(rows, least):
        for k, n in enumerate(ids.tolist()):
            window = tuple(r[k: k + span])
            of[window] = min(n, of.get(window, n))
    none = np.iinfo(np.int64).max
    phrases = Phrases([b" ".join(r) for r in rows], [x.tobytes() for x in least], span)
    tracemalloc.start()
    found, begin = phrases.least_ids([b" ".join(s) for s in segs], np.array([len(s) for s in segs]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for s, at in zip(segs, begin):
        want = [of.get(tuple(s[k: k + span]), none) for k in range(len(s) - span + 1)]
        assert found[at: at + len(want)].tolist() == want
    assert (found < none).sum() > 20 and peak < 100e6, peak


def test_known_repeats_of_a_wide_group_are_not_joined_again(spark, monkeypatch):
    """They were dealt to their text with its other segments; a second join would only find them once more."""
    monkeypatch.setattr(passages, "WIDE", 3)
    rng = random.Random(4)
    some = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    shared = some(70)
    docs = [(i, " ".join(some(5) + shared + some(5))) for i in range(60)] + [(100, "")]
    docs += [(1_000 + i, text) for i, text in docs[:20]]
    found = remove_repeated_phrases(spark.createDataFrame(docs, "id bigint, text string").repartition(3), span=40)
    got = {r.id: (r.n_words, r.n_removed, r.text) for r in found.collect()}
    assert got == brute_words(docs, 40)
    assert all(x[1] == x[0] for i, x in got.items() if i >= 1_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Join \[anchor#\d+L?\], \[anchor#\d+L?\], (\w+)", plan).count("Inner") == 0
    assert "known" in plan
