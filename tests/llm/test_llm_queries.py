"""The numbered queries against their SQL, or brute force, and the pipeline."""

import hashlib
import re

import pytest

import corpus_pipeline
from check_oracles import compare, connect
from cribble.llm.queries import oracle_sql, queries
from test_llm_passages import brute_bytes, brute_words
from test_llm_sets import brute
from test_llm_warc import sha1

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(queries()[name](spark, FOLDER), connect(FOLDER), oracle_sql()[name]) is None


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def sha256(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op3(spark):
    rows = queries()["op3_language_id"](spark, FOLDER).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and langs[r.doc_id]]
    assert len(rows) == len(langs) and sum(r.lang_pred == langs[r.doc_id] for r in held) > 0.9 * len(held)


def test_op4(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    last = {}
    for p in pages:
        last[p.html or ""] = max(p.page_id, last.get(p.html or "", -1))
    want = {p.page_id: (len((p.html or "").encode()), sha1(p.html), "response" if last[p.html or ""] == p.page_id else "revisit",
                        None if last[p.html or ""] == p.page_id else last[p.html or ""]) for p in pages}
    assert {r.page_id: tuple(r)[1:] for r in queries()["op4_warc"](spark, FOLDER).collect()} == want


def test_op7(spark, docs):
    rows = queries()["op7_jaccard_join"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, 90)


def test_op8(spark, docs):
    rows = queries()["op8_suffix_dedup"](spark, FOLDER).collect()
    want = {i: (*x[:3], sha256(x[3])) for i, x in brute_bytes(docs, 100).items()}
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want


def test_op9(spark, docs):
    rows = queries()["op9_phrase_dedup"](spark, FOLDER).collect()
    want = {i: (*x[:2], sha256(x[2])) for i, x in brute_words(docs, 50).items()}
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on rows with nulls, repeated rows and shared ids."""
    from test_llm_lines import brute_lines

    base = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = base.limit(5).unionByName(base.selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars").limit(20))
    odd = spark.createDataFrame([(None, None, None, None, None), (9000, None, "en", "src1", 0), (9001, "short", None, None, 5)], base.schema)
    base.unionByName(extra).unionByName(odd).withColumn("id", base.doc_id * 0).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder, rows = str(tmp_path), None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    one = stages["quality rules"](spark, docs, folder).collect()
    # No source of these tables fails, so only the base rule speaks.
    def base_ok(r):
        w = words(r.text)
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k: k + 5]), []).append(k)
        hit = {p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + 5)}
        return len(w) >= 10 and 100 * len(hit) <= 20 * len(w)
    key = lambda r: (r.doc_id, r.text)
    assert sorted(map(str, map(key, one))) == sorted(str(key(r)) for r in kept if base_ok(r))

    frame = spark.createDataFrame(one, base.schema)
    two = stages["line dedup"](spark, frame, folder).collect()
    want = brute_lines([(r.doc_id, r.text) for r in one])
    assert sorted((r.doc_id, r.text, r.n_chars) for r in two) == sorted((r.doc_id, want[r.doc_id], len(want[r.doc_id])) for r in one)

    frame = spark.createDataFrame(two, base.schema)
    three = stages["n-gram Jaccard join"](spark, frame, folder).collect()
    # Five words and 0.8. Texts that line dedup has emptied link with nothing, so each of their rows stays.
    comps = brute([(r.doc_id, r.text) for r in two], 80, 5)
    empty = [r.doc_id for r in two if not words(r.text)]
    assert sorted(r.doc_id for r in three) == sorted([*{c for _, c in comps.values()} - set(empty), *empty])

    frame = spark.createDataFrame(three, base.schema)
    four = stages["benchmark decontamination"](spark, frame, folder).collect()
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = {tuple(w[k: k + 13]) for w in items for k in range(len(w) - 12)}
    def clean(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        hit = {p for k in range(len(w) - 12) if tuple(w[k: k + 13]) in grams for p in range(k, k + 13)}
        return not hit or 20 * len(hit) < len(w)
    assert sorted(r.doc_id for r in four) == sorted(r.doc_id for r in three if clean(r.text))

    final = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in final} <= {r.doc_id for r in four}
    sizes = {r.doc_id: len(words(r.text)) for r in four}
    by_source = {}
    for r in final:
        assert r.size == sizes[r.doc_id] and 0 < r.taken <= 2 * r.size
        by_source.setdefault((r.source, r.target), []).append(r.taken)
    for (_, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= 1
    assert rows is None


def test_near_copies_of_five_words_and_four_fifths_go(spark):
    """Four scattered words changed in 200: 176 of 216 shingles of five words, but 186 of 210 of three."""
    text = [f"w{k}" for k in range(200)]
    four, five = ([f"other{n}_{k}" if k % 40 == 20 and k < 40 * n else w for k, w in enumerate(text)] for n in (4, 5))
    rows = [(2, " ".join(text)), (5, " ".join(four)), (7, " ".join(f"x{w}" for w in text)), (9, " ".join(f"x{w}" for w in five))]
    frame = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    # Five words changed leave 171 of 221 shingles, under 0.8.
    assert sorted(r.doc_id for r in left) == [2, 7, 9]


def test_near_duplicates_of_the_table_against_brute_force(spark, docs):
    def shingles(text):
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text))
        return frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} - {()})

    sets = {i: shingles(t) for i, t in docs}
    least = {i: i for i in sets}

    def find(x):
        return x if least[x] == x else find(least[x])

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                least[hi] = lo
    base = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = corpus_pipeline.near_duplicates(spark, base, FOLDER).collect()
    assert sorted(r.doc_id for r in left) == sorted({find(i) for i in ids})
