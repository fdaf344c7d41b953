"""Weak labels, gates, quotas, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.catalog.lexical import LEX, scored_sql
from cribble.catalog.registry import (
    QUEUE_SQL,
    SAMPLES_SQL,
    Tables,
    now,
    query,
    queue,
    samples,
    transcripts,
)
from cribble.functions.text import language_gate, transcript_text
from cribble.operators import labels, reports, sampling
from cribble.operators.features import score_texts
from cribble.operators.queue import transition
from cribble.operators.ranking import top_per_group
from cribble.sources.source_lists import read_source_lists

SOURCES = S.SourceLists(
    users=("u1", "u2", "u3"),
    trusted_positive_channels=("ch3", "ch6", "ch9", "ch12", "ch15"),
    trusted_negative_channels=("ch6", "ch18", "ch21"),
    trusted_positive_feeds=("https://feeds.example.com/f2/", "https://FEEDS.example.com/f4?utm=1"),
    trusted_negative_feeds=("https://feeds.example.com/f8", "https://feeds.example.com/f10", "https://feeds.example.com/f4"),
    trusted_negative_users=("u4", "u6"),
)
LABEL_SQL = f"""{QUEUE_SQL}, n AS (SELECT *, CASE WHEN meta_kind = 'full' THEN meta_channel END AS ch,
CASE WHEN meta_kind = 'full' THEN lower(regexp_replace(regexp_replace(meta_feed, '[?#].*$', ''), '/+$', '')) END AS fd,
CASE WHEN meta_kind = 'full' THEN meta_user END AS us FROM q),
lab AS (SELECT *, CASE WHEN ch IN ('ch3', 'ch6', 'ch9', 'ch12', 'ch15') THEN 'WEAK_POSITIVE'
WHEN ch IN ('ch18', 'ch21') THEN 'WEAK_NEGATIVE'
WHEN fd IN ('https://feeds.example.com/f2', 'https://feeds.example.com/f4') THEN 'WEAK_POSITIVE'
WHEN fd IN ('https://feeds.example.com/f8', 'https://feeds.example.com/f10') THEN 'WEAK_NEGATIVE'
WHEN us IN ('u1', 'u2', 'u3') THEN 'WEAK_POSITIVE' WHEN us IN ('u4', 'u6') THEN 'WEAK_NEGATIVE' END AS label FROM n)"""


@query("J2, S9", f"WITH {LABEL_SQL} SELECT id, label FROM lab")
def classify_by_source(t: Tables) -> DataFrame:
    trusted = read_source_lists(t.spark, SOURCES)
    return labels.classify_by_source(queue(t), trusted).select("id", "label")


# A trusted table that grows with the data: every customer key is a channel.
@query("J2", """SELECT o_orderkey AS id, CASE WHEN c_acctbal >= 4000 THEN 'WEAK_POSITIVE' WHEN c_acctbal < 2000 THEN 'WEAK_NEGATIVE' END AS label
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def classify_by_source_table(t: Tables) -> DataFrame:
    trusted = t.customer.where("c_acctbal >= 4000 OR c_acctbal < 2000").selectExpr(
        "'channel' AS kind", "'c' || c_custkey AS value",
        "CASE WHEN c_acctbal >= 4000 THEN 'positive' ELSE 'negative' END AS polarity")
    items = t.orders.select(F.col("o_orderkey").alias("id"), F.create_map(
        F.lit("channel_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("source_metadata"))
    return labels.classify_by_source(items, trusted).select("id", "label")


@query("J2, X1, A7", f"""WITH {LABEL_SQL} SELECT CASE WHEN status = 'SCREENED' AND meta_kind <> 'null'
THEN coalesce(label, 'SCREENED_NO_LABEL') ELSE status END AS status, count(*) AS n FROM lab GROUP BY 1""")
def label_by_source(t: Tables) -> DataFrame:
    q = queue(t)
    updates = labels.label_by_source(q, read_source_lists(t.spark, SOURCES))
    return transition(q, updates, now()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- Transcripts -----------------------------------------------------------

TEXT_SQL = f"""{SAMPLES_SQL}, tx AS (SELECT id, string_agg(coalesce(text, ''), ' ' ORDER BY sample_idx) AS text,
avg(CASE WHEN language = 'user' THEN coalesce(language_probability, 0e0) END) AS confidence FROM s GROUP BY 1)"""


@query("A5", f"WITH {TEXT_SQL} SELECT id, text FROM tx")
def transcript_texts(t: Tables) -> DataFrame:
    return transcripts(t).select("id", transcript_text("screening_samples").alias("text"))


@query("A5", f"WITH {TEXT_SQL} SELECT id, text FROM tx")
def joined_samples(t: Tables) -> DataFrame:
    return labels.join_samples(samples(t))


@query("A4", f"WITH {TEXT_SQL} SELECT id, round(confidence, 6) AS confidence FROM tx")
def language_means(t: Tables) -> DataFrame:
    return labels.language_means(samples(t), "user").select(
        "id", F.round("confidence", 6).alias("confidence"))


@query("P15", f"""WITH {TEXT_SQL} SELECT id, coalesce(confidence >= 0.70e0, false) AS passed,
coalesce(round(confidence, 3), 0e0) AS probability FROM tx""")
def language_gates(t: Tables) -> DataFrame:
    return transcripts(t).select("id", language_gate("screening_samples", "user").alias("g")).select("id", "g.*")


LIMITS = S.Thresholds(language="user")
NEG_SQL = f"""{TEXT_SQL}, it AS (SELECT c_custkey AS id FROM customer),
{scored_sql("tx", "id").strip()}, oc AS (SELECT it.id, CASE WHEN tx.id IS NULL THEN 'no_transcript'
WHEN NOT coalesce(confidence >= 0.70e0, false) THEN 'not_language' WHEN raw_score >= 0 THEN 'score_not_negative'
WHEN msa + egy + gulf + sy = 0 THEN 'no_signal' ELSE 'WEAK_NEGATIVE' END AS outcome
FROM it LEFT JOIN tx ON it.id = tx.id LEFT JOIN scored ON it.id = scored.id)"""


def waiting(t: Tables) -> DataFrame:
    """Customers as items; only some have a conversation as their transcript."""
    return t.customer.select(F.col("c_custkey").alias("id"))


@query("P14, J3", f"WITH {NEG_SQL} SELECT * FROM oc")
def lexical_negatives(t: Tables) -> DataFrame:
    items = labels.attach_transcripts(waiting(t), transcripts(t), "skip")
    return labels.lexical_negative(items, LEX, thresholds=LIMITS).select("id", "outcome")


@query("P14", f"WITH {NEG_SQL} SELECT * FROM oc")
def lexical_negatives_flat(t: Tables) -> DataFrame:
    flat = labels.join_samples(samples(t)).join(labels.language_means(samples(t), "user"), "id")
    items = waiting(t).join(flat, "id", "left")
    return labels.lexical_negative_flat(items, LEX, thresholds=LIMITS).select("id", "outcome")


OUTCOMES = ("WEAK_NEGATIVE", "no_transcript", "not_language", "score_not_negative", "no_signal")


@query("A7", f"WITH {NEG_SQL} SELECT " + ", ".join(
    f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in OUTCOMES) + ", count(*) AS total FROM oc")
def labelling_report(t: Tables) -> DataFrame:
    return reports.outcome_report(lexical_negatives(t), OUTCOMES)


@query("J3", f"""WITH {QUEUE_SQL}, {SAMPLES_SQL}, d AS (SELECT DISTINCT id FROM s) SELECT q.id,
CASE WHEN d.id IS NULL THEN 'ERROR_SCORING' ELSE status END AS status,
CASE WHEN d.id IS NULL THEN 'Missing transcript' ELSE error_msg END AS error_msg, d.id IS NULL AS missing
FROM q LEFT JOIN d ON q.id = d.id WHERE status = 'SCREENED'""")
def missing_transcripts(t: Tables) -> DataFrame:
    items = queue(t).where("status = 'SCREENED'").select("id", "status", "error_msg")
    return labels.attach_transcripts(items, transcripts(t), "error").select(
        "id", "status", "error_msg", "missing")


@query("P16", """SELECT doc_id, CASE WHEN n_chars % 1001 / 1000e0 >= 0.75e0 THEN 'POTENTIAL_LB'
WHEN n_chars % 1001 / 1000e0 >= 0.50e0 THEN 'BORDERLINE_LB' ELSE 'REJECTED' END AS tier FROM documents""")
def tiers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", labels.tier(F.expr("n_chars % 1001 / 1000e0")).alias("tier"))


@query("U2, P17", f"""WITH {scored_sql("documents", "doc_id").strip()}, j AS (SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN
CASE WHEN l.toxic = 1 THEN 'REJECTED' ELSE 'WEAK_POSITIVE' END ELSE 'WEAK_NEGATIVE' END AS status, strong_lb_hits
FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN scored s ON s.doc_id = d.doc_id)
SELECT id, status, CASE WHEN status = 'WEAK_POSITIVE' THEN 1 ELSE 0 END AS label FROM j
WHERE status <> 'WEAK_POSITIVE' OR strong_lb_hits >= 1""")
def training_set(t: Tables) -> DataFrame:
    return labels.training_set(labelled_documents(t), check_size=True).select("id", "status", "label")


def labelled_documents(t: Tables) -> DataFrame:
    joined = t.texts.join(t.labels, "doc_id").selectExpr(
        "doc_id AS id", "text",
        "CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'REJECTED' ELSE 'WEAK_POSITIVE' END ELSE 'WEAK_NEGATIVE' END AS status")
    return score_texts(joined, LEX)


# --- Quotas, samples, splits ----------------------------------------------

# part as a contrastive corpus: type is the class, every ninth row is broken,
# some rows repeat the URL of another or are queued already.
QUOTA_E = {
    "url": "'http://c/' || CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 2 ELSE p_partkey END",
    "dialect": "p_type",
    "ok": "p_partkey % 9 > 0",
    "file_pos": "p_partkey % 4",
    "row_pos": "p_partkey",
}
TARGETS = {"ECONOMY": "a", "SMALL": "b", "STANDARD": "c", "PROMO": "d"}
QUOTA = 60
QUOTA_SQL = f"""r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in QUOTA_E.items())} FROM part),
have AS (SELECT p_type AS dialect, count(*) AS n FROM part WHERE p_size > 45 AND p_type <> 'PROMO' AND p_retailprice < 905 GROUP BY 1
UNION ALL SELECT 'PROMO', {QUOTA}),
pres AS (SELECT 'http://c/' || p_partkey AS url FROM part WHERE p_size < 6),
ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY file_pos, row_pos) AS rn FROM r
WHERE dialect IN ('ECONOMY', 'SMALL', 'STANDARD', 'PROMO') AND ok) WHERE rn = 1 AND url NOT IN (SELECT url FROM pres)),
rk AS (SELECT ok.*, row_number() OVER (PARTITION BY ok.dialect ORDER BY file_pos, row_pos) AS k, {QUOTA} - coalesce(have.n, 0) AS room
FROM ok LEFT JOIN have ON ok.dialect = have.dialect),
cut AS (SELECT dialect, file_pos * 1000000000 + row_pos AS c FROM rk WHERE k = room
UNION ALL SELECT dialect, -1 FROM have WHERE n >= {QUOTA}),
qo AS (SELECT r.url, r.dialect, r.file_pos, r.row_pos, CASE WHEN r.dialect NOT IN ('ECONOMY', 'SMALL', 'STANDARD', 'PROMO') THEN 'not_target'
WHEN r.file_pos * 1000000000 + r.row_pos > cut.c THEN 'quota_full' WHEN NOT r.ok THEN 'failed'
WHEN ok.url IS NULL THEN 'already_present' ELSE 'added' END AS outcome FROM r LEFT JOIN cut ON r.dialect = cut.dialect
LEFT JOIN ok ON r.url = ok.url AND r.file_pos = ok.file_pos AND r.row_pos = ok.row_pos)"""


def quota_outcomes(t: Tables) -> DataFrame:
    rows = t.part.selectExpr(*[f"{e} AS {n}" for n, e in QUOTA_E.items()])
    have = t.part.where("p_size > 45 AND p_type <> 'PROMO' AND p_retailprice < 905").groupBy(
        F.col("p_type").alias("dialect")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        t.spark.createDataFrame([("PROMO", QUOTA)], "dialect string, n long"))
    present = t.part.where("p_size < 6").selectExpr("'http://c/' || p_partkey AS url")
    return sampling.quota_per_class(rows, have, present, TARGETS, QUOTA)


@query("W2, T3", f"WITH {QUOTA_SQL} SELECT row_pos, dialect, outcome FROM qo")
def quota_per_class(t: Tables) -> DataFrame:
    return quota_outcomes(t).select("row_pos", "dialect", "outcome")


@query("A7, W2", f"WITH {QUOTA_SQL} SELECT " + ", ".join(
    f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("added", "not_target", "quota_full", "failed", "already_present"))
    + ", count(*) AS total FROM qo")
def quota_report(t: Tables) -> DataFrame:
    return reports.outcome_report(quota_outcomes(t), ("added", "not_target", "quota_full", "failed", "already_present"))


STRATA_SQL = "(CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SAMPLE_STRATA.items()) + " END)"
SAMPLE_SQL = f"""{QUEUE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY md5(id || ':42'), id) AS rn FROM q
WHERE audio_path IS NOT NULL), smp AS (SELECT id, url, platform, audio_path, status AS source_status,
CAST(row_number() OVER (ORDER BY md5(id || ':43'), id) - 1 AS INT) AS pos FROM k WHERE rn <= {STRATA_SQL})"""


@query("W3, W7, P13", f"WITH {SAMPLE_SQL} SELECT * FROM smp")
def stratified_sample(t: Tables) -> DataFrame:
    from cribble.plans.stages import annotation_sample

    return annotation_sample(queue(t))


@query("W3", f"""WITH {QUEUE_SQL}, dim AS ({" UNION ALL ".join(f"SELECT '{k}' AS status, {v} AS wanted" for k, v in S.SAMPLE_STRATA.items())})
SELECT dim.status, CAST(any_value(wanted) AS BIGINT) AS wanted, count(q.id) AS available, count(q.id) < any_value(wanted) AS short
FROM dim LEFT JOIN q ON q.status = dim.status GROUP BY 1""")
def strata_shortfall(t: Tables) -> DataFrame:
    return sampling.strata_shortfall(queue(t))


@query("W2, W3, W4", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)
SELECT l_returnflag, l_orderkey, l_linenumber, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5000""")
def top_of_large_classes(t: Tables) -> DataFrame:
    """Five thousand of each class, classes that hold a third of all rows."""
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_per_group(rows, ["l_returnflag"], order, 5_000).drop("l_extendedprice")


@query("W8", """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(id || ':42'), id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM r)
SELECT id, label, rn <= round(n * 0.2e0) AS holdout FROM k""")
def stratified_split(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey AS id", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label")
    return sampling.stratified_split(rows)


# events as annotations: a user's id is the item, later events replace earlier.
TRUTH = "CASE event_type WHEN 'signup' THEN 'lebanese' WHEN 'view' THEN 'not_lebanese' WHEN 'click' THEN 'mostly_lebanese' WHEN 'error' THEN 'skip' ELSE 'unclear' END"
ANN_SQL = f"""ann AS (SELECT user_id AS item_id, ground_truth, seq FROM (SELECT user_id, {TRUTH} AS ground_truth, event_id AS seq,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


def annotations(t: Tables) -> DataFrame:
    raw = t.events.selectExpr("user_id AS item_id", f"{TRUTH} AS ground_truth", "event_id AS seq", "ts AS timestamp")
    return sampling.latest_annotation(raw)


@query("W6", f"WITH {ANN_SQL} SELECT item_id, ground_truth, seq FROM ann")
def latest_annotation(t: Tables) -> DataFrame:
    return annotations(t).select("item_id", "ground_truth", "seq")


@query("J6", f"""WITH {ANN_SQL}, smp AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % 100003 AS INT) AS pos FROM customer)
SELECT id, pos FROM smp WHERE id NOT IN (SELECT item_id FROM ann WHERE ground_truth <> 'skip')""")
def unlabelled(t: Tables) -> DataFrame:
    sample = t.customer.selectExpr("c_custkey AS id", "CAST((c_custkey * 7919) % 100003 AS INT) AS pos")
    return sampling.unlabelled(sample, annotations(t))


@query("J7", """SELECT d.doc_id AS id, d.lang AS status, CASE WHEN quality = 1 THEN 'lebanese' ELSE 'not_lebanese' END AS ground_truth
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def join_truth(t: Tables) -> DataFrame:
    from cribble.operators.evaluate import join_truth as op

    predictions = t.documents.selectExpr("doc_id AS id", "lang AS status")
    return op(predictions, t.labels.selectExpr(
        "doc_id AS item_id", "CASE WHEN quality = 1 THEN 'lebanese' ELSE 'not_lebanese' END AS ground_truth"))
