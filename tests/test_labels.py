import random

import pytest
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.functions.lexicon import Lexicons
from cribble.operators import evaluate as ev
from cribble.operators import labels, reports, sampling
from cribble.sources.source_lists import read_source_lists, used_fall_back

LEX = Lexicons.from_lists({
    "lb": ["lb"], "msa": ["ms"], "egy": ["eg"], "gulf": ["gu"], "sy": ["sy"], "strong_lb_hits": ["st"]})
SAMPLES = "array<struct<language:string,language_probability:double,text:string>>"


def items(spark, *metas):
    return spark.createDataFrame([(i, m) for i, m in enumerate(metas)], "id long, source_metadata map<string,string>")


LISTS = S.SourceLists(
    trusted_positive_channels=("c+", "both"), trusted_negative_channels=("c-", "both"),
    trusted_positive_feeds=("https://F.com/a/",), trusted_negative_feeds=("https://f.com/b?x",),
    users=("u+",), trusted_negative_users=("u-",))
METAS = [
    None, {}, {"channel_id": "c+"}, {"channel_id": "c-"}, {"channel_id": "both"},
    {"channel_id": "zz", "feed_url": "HTTPS://f.com/A///?q=1"}, {"feed_url": "https://f.com/b"},
    {"channel_id": "c-", "user": "u+"}, {"user": "u+"}, {"user": "u-"}, {"channel_id": "", "user": "u-"},
    {"user": "f.com"}, {"feed_url": ""},
]
LABELS = [None, None, "WEAK_POSITIVE", "WEAK_NEGATIVE", "WEAK_POSITIVE", "WEAK_POSITIVE", "WEAK_NEGATIVE",
          "WEAK_NEGATIVE", "WEAK_POSITIVE", "WEAK_NEGATIVE", "WEAK_NEGATIVE", None, None]


@pytest.mark.parametrize("hinted", [True, False])
def test_classify_by_source(spark, hinted, monkeypatch):
    if not hinted:
        monkeypatch.setattr(labels, "broadcast_if_small", lambda d: d)
    out = labels.classify_by_source(items(spark, *METAS), read_source_lists(spark, LISTS)).orderBy("id").collect()
    assert [r.label for r in out] == LABELS


def test_source_lists_fall_back_one_by_one(spark):
    lists = S.SourceLists(channels=("p",), feeds=("f",), trusted_positive_feeds=("t",))
    rows = {tuple(r) for r in read_source_lists(spark, lists).collect()}
    assert rows == {("channel", "p", "positive"), ("feed", "t", "positive")}
    assert used_fall_back(lists) == {"channel": True, "feed": False, "user": True}
    assert read_source_lists(spark, lists, fall_back=False).count() == 1


def transcripts(spark, *rows):
    return spark.createDataFrame(list(rows), f"id long, screening_samples {SAMPLES}")


def test_lexical_negative_reasons_in_order(spark):
    docs = transcripts(
        spark, (1, [("ar", 0.9, "ms ms"), ("ar", 0.5, "eg")]), (2, [("en", 1.0, "ms")]), (3, [("ar", 0.69, "ms")]),
        (4, [("ar", 0.9, "lb eg")]), (5, [("ar", 0.9, "nothing")]), (6, []), (7, [("ar", 0.9, "sy")]))
    waiting = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    joined = labels.attach_transcripts(waiting, docs, "skip")
    out = {r.id: r.outcome for r in labels.lexical_negative(joined, LEX).collect()}
    # 5 scores exactly 0, which is not negative.
    assert out == {1: "WEAK_NEGATIVE", 2: "not_language", 3: "not_language", 4: "score_not_negative", 5: "score_not_negative",
                   6: "not_language", 7: "WEAK_NEGATIVE", 8: "no_transcript"}
    report = reports.outcome_report(labels.lexical_negative(joined, LEX), ("WEAK_NEGATIVE", "not_language", "no_signal")).first()
    assert tuple(report) == (2, 3, 0, 8)


def test_no_signal_needs_a_negative_score_without_hits(spark):
    weights = S.LexiconWeights(lb=-1.0)
    joined = transcripts(spark, (1, [("ar", 0.9, "lb")]))
    assert labels.lexical_negative(joined, LEX, weights).first().outcome == "no_signal"


def test_attach_policies(spark):
    docs = transcripts(spark, (1, []))
    waiting = spark.createDataFrame([(1, "SCREENED", "e"), (2, "SCREENED", "e")], "id long, status string, error_msg string")
    assert labels.attach_transcripts(waiting, docs, "drop").count() == 1
    out = {r.id: r for r in labels.attach_transcripts(waiting, docs, "error").collect()}
    assert (out[1].status, out[1].error_msg) == ("SCREENED", "e")
    assert (out[2].status, out[2].error_msg, out[2].missing) == ("ERROR_SCORING", "Missing transcript", True)
    with pytest.raises(ValueError):
        labels.attach_transcripts(waiting, docs, "other")


@pytest.mark.parametrize("p,tier", [(0.75, "POTENTIAL_LB"), (0.7499999, "BORDERLINE_LB"), (0.5, "BORDERLINE_LB"),
                                    (0.4999999, "REJECTED"), (None, "REJECTED")])
def test_tier(spark, p, tier):
    assert spark.createDataFrame([(p,)], "p double").select(labels.tier("p")).first()[0] == tier


def test_training_set(spark):
    rows = [(i, s, h) for i, (s, h) in enumerate(
        [("WEAK_POSITIVE", 0), ("WEAK_POSITIVE", 1), ("WEAK_NEGATIVE", 0), ("REJECTED", 0), ("SCREENED", 3)])]
    df = spark.createDataFrame(rows, "id long, status string, hits int")
    got = labels.training_set(df, check_size=False, hits="hits").collect()
    assert {(r.id, r.label) for r in got} == {(1, 1), (2, 0), (3, 0)}
    assert labels.training_set(df, include_rejected=False, check_size=False, hits="hits").count() == 2
    with pytest.raises(ValueError, match="Not enough"):
        labels.training_set(df, hits="hits")


# --- Quotas ----------------------------------------------------------------

def simulate(rows, existing, present, targets, quota):
    """One pass in file order, a row at a time."""
    have, seen, out = dict(existing), set(present), {}
    for url, cls, ok, f, r in sorted(rows, key=lambda x: (x[3], x[4])):
        if cls not in targets:
            out[(f, r)] = "not_target"
        elif have.get(cls, 0) >= quota:
            out[(f, r)] = "quota_full"
        elif not ok:
            out[(f, r)] = "failed"
        elif url in seen:
            out[(f, r)] = "already_present"
        else:
            seen.add(url)
            have[cls] = have.get(cls, 0) + 1
            out[(f, r)] = "added"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_quota_against_a_row_by_row_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(f"u{i if rng.random() > .2 else rng.randint(0, i)}", rng.choice("AAAABCX"), rng.random() > .3, i % 3, i) for i in range(300)]
    # One URL belongs to one class, as its id does in a corpus.
    cls = {}
    rows = [(u, cls.setdefault(u, c), ok, f, r) for u, c, ok, f, r in rows]
    existing = {"A": 3, "B": 25, "X": 99}
    present = {f"u{i}" for i in range(0, 300, 9)}
    targets = {"A": "a", "B": "b", "C": "c", "D": "d"}
    out = sampling.quota_per_class(
        spark.createDataFrame(rows, "url string, dialect string, ok boolean, file_pos long, row_pos long"),
        spark.createDataFrame(list(existing.items()), "dialect string, n long"),
        spark.createDataFrame([(u,) for u in present], "url string"), targets, 25)
    got = {(r.file_pos, r.row_pos): r.outcome for r in out.collect()}
    assert got == simulate(rows, existing, present, targets, 25)


# --- Samples ---------------------------------------------------------------

def test_sample_sizes_and_shortfall(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 3, "A").when(F.col("id") < 500, "B").otherwise("Z").alias("status"))
    strata = {"A": 5, "B": 7, "C": 2}
    first = sampling.shuffle_sample(sampling.stratified_sample(df, strata)).collect()
    again = sampling.shuffle_sample(sampling.stratified_sample(df.repartition(5), strata)).collect()
    assert {tuple(r) for r in first} == {tuple(r) for r in again}
    assert sorted(r.status for r in first) == ["A"] * 3 + ["B"] * 7
    assert sorted(r.pos for r in first) == list(range(10))
    other = sampling.stratified_sample(df, strata, seed=43).collect()
    assert {r.id for r in other} != {r.id for r in first}
    short = {r.status: (r.wanted, r.available, r.short) for r in sampling.strata_shortfall(df, strata).collect()}
    assert short == {"A": (5, 3, True), "B": (7, 497, False), "C": (2, 0, True)}


def test_split_is_exact_per_class(spark):
    df = spark.range(2001).select("id", (F.col("id") % 10 < 7).cast("int").alias("label"))
    out = sampling.stratified_split(df).groupBy("label").agg(F.count_if("holdout").alias("h"), F.count("*").alias("n")).collect()
    assert {r.label: (r.h, r.n) for r in out} == {1: (280, 1401), 0: (120, 600)}
    single = sampling.stratified_split(spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "id long, label int"))
    assert single.where("label = 1 AND holdout").count() == 0


def test_annotations_replace_and_skip(spark):
    raw = spark.createDataFrame([(1, "skip", "t1", 1), (1, "lebanese", "t1", 2), (2, "unclear", "t2", 3), (2, "skip", "t3", 4)],
                                "item_id long, ground_truth string, timestamp string, seq int")
    last = sampling.latest_annotation(raw)
    assert {r.item_id: r.ground_truth for r in last.collect()} == {1: "lebanese", 2: "skip"}
    assert {r.item_id for r in sampling.latest_annotation(raw.drop("seq")).collect()} == {1, 2}
    sample = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "id long, pos int")
    assert [r.id for r in sampling.unlabelled(sample, last).collect()] == [3, 2]


# --- Metrics ---------------------------------------------------------------

def test_published_rates_from_their_counts(spark):
    counts = spark.createDataFrame([(62, 50, 20, 164)], "tp long, fp long, fn long, tn long")
    r = ev.add_rates(counts).first()
    assert (round(r.precision, 3), round(r.recall, 3), round(r.accuracy, 3)) == (0.554, 0.756, 0.764)
    assert round(r.f1, 3) == 0.639


def test_sweep_on_rows(spark):
    rows = [("lebanese", 0.8)] * 62 + [("not_lebanese", 0.75)] * 50 + [("mostly_lebanese", 0.7)] * 20 + [
        ("not_lebanese", 0.1)] * 164 + [("unclear", 0.9)] * 4 + [("skip", 0.9)]
    df = spark.createDataFrame(rows, "ground_truth string, probability double")
    out = {r.threshold: r for r in ev.threshold_sweep(df, [0.75, 0.9]).collect()}
    assert (out[0.75].tp, out[0.75].fp, out[0.75].fn, out[0.75].tn) == (62, 50, 20, 164)
    assert (out[0.9].precision, out[0.9].recall, out[0.9].f1) == (0.0, 0.0, 0.0)


def test_tier_interval(spark):
    rows = [("WP", "lebanese")] * 15 + [("WP", "mostly_lebanese")] * 15 + [("WP", "not_lebanese")] * 11 + [("WP", "unclear")] * 4
    df = spark.createDataFrame(rows, "status string, ground_truth string")
    r = ev.tier_precision(df).first()
    assert (r.n, r.lebanese, r.unclear, round(r.precision, 3), round(r.ci_low, 2), round(r.ci_high, 2)) == (45, 15, 4, 0.667, 0.53, 0.8)
    assert ev.tier_precision(df, count_unclear=False).first().n == 41
    sure = spark.createDataFrame([("T", "lebanese")], "status string, ground_truth string")
    assert ev.tier_precision(sure).first().ci_high == 1.0


def auc_by_pairs(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_auc_against_all_pairs(spark, digits):
    rng = random.Random(digits)
    rows = [(int(rng.random() < .3), round(rng.random(), digits)) for _ in range(400)]
    r = ev.roc_auc(spark.createDataFrame(rows, "label int, score double")).first()
    assert r.auc == pytest.approx(auc_by_pairs(rows), abs=1e-12)


def test_auc_edges(spark):
    same = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "label int, score double")
    assert ev.roc_auc(same).first().auc == 0.5
    one_class = spark.createDataFrame([(1, 0.5)], "label int, score double")
    assert tuple(ev.roc_auc(one_class).first()) == (None, 1, 0, 0)


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 0)], "label int, prediction int")
    out = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert (out["0"].precision, out["0"].recall, out["1"].precision, out["1"].f1) == (0.5, 1.0, 0.0, 0.0)
    assert out["accuracy"].f1 == 0.5 and out["macro avg"].support == 4
    assert out["weighted avg"].recall == 0.5


def test_marker_sweep(spark):
    df = spark.createDataFrame([(0, "lebanese"), (1, "lebanese"), (2, "not_lebanese"), (5, None)], "strong_lb_hits int, ground_truth string")
    out = {r.min_hits: (r.kept, r.annotated, r.positive) for r in ev.marker_sweep(df, [0, 1, 3]).collect()}
    assert out == {0: (4, 3, 2), 1: (3, 2, 1), 3: (1, 0, 0)}


def test_profile_and_distribution(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.4), ("a", 0.2), ("a", 0.3), ("b", None)], "ground_truth string, probability double")
    out = {r.ground_truth: r for r in ev.probability_profile(df).collect()}
    assert (out["a"].n, out["a"].median, out["a"].min, out["a"].max) == (4, 0.25, 0.1, 0.4)
    assert out["b"].n == 0 and out["b"].median is None
    assert {r.ground_truth: r.share for r in ev.truth_distribution(df).collect()} == {"a": 0.8, "b": 0.2}


def test_class_weights_sum_to_n(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 9, "label int")
    assert {r.label: r.weight for r in ev.class_weights(df).collect()} == {1: 2.0, 0: pytest.approx(12 / 18)}
