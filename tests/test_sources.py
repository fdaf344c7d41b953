import json
import os

import pytest
from pyspark.sql import functions as F

from cribble.operators import model as ml
from cribble.operators.features import embed_text, feature_array, fit_embedder, attach_embeddings
from cribble.schemas import QUEUE, TRANSCRIPT
from cribble.sources import annotations, dumps, feeds, tables, transcripts
from cribble.streaming.dedup import dedup_ingest, distinct_urls, distinct_urls_within
from cribble.streaming.drain import drain, read_drained


# --- Feeds and dumps -------------------------------------------------------

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:itunes="http://i" xmlns:atom="http://at"><channel><title>T &amp; U</title>
<itunes:author>Who</itunes:author><language>ar</language>
<item><title>One</title><guid>g1</guid><pubDate>d</pubDate>
<enclosure url="http://a/1.pdf" type="x"/><enclosure url="http://a/1.mp3" type="audio/mpeg"/><link>http://l/1</link></item>
<item><title>Two</title></item>
<item><title>Three</title><link>http://l/3</link><atom:link href="http://l/3.mp3" rel="x"/></item></channel></rss>"""


def test_rss(spark):
    docs = spark.createDataFrame([("f1", 0, RSS), ("bad", 1, "<rss><channel><item>"), ("none", 2, None)],
                                 "feed_url string, source_pos long, xml string")
    rows = feeds.rss_items(docs).orderBy("item_pos").collect()
    assert [(r.feed_url, r.item_pos, r.title) for r in rows] == [("f1", 0, "One"), ("f1", 1, "Two"), ("f1", 2, "Three")]
    assert [e.url for e in rows[0].enclosures] == ["http://a/1.pdf", "http://a/1.mp3"]
    assert [x.href for x in rows[0].links] == ["http://l/1"] and rows[1].enclosures == [] and rows[1].links == []
    assert [x.href for x in rows[2].links] == ["http://l/3", "http://l/3.mp3"]
    m = feeds.rss_feed_meta(docs).first()
    assert (m.itunes_author, m.language, m.author) == ("Who", "ar", None)


def test_atom(spark):
    xml = ('<feed><title>c</title><entry><id>1</id><title>a</title><link rel="alternate" href="http://v/1"/>'
           '<published>p</published></entry><entry><title>no link</title></entry>'
           '<entry><title>b</title><link rel="self" href="http://s"/><link href="http://v/2"/></entry></feed>')
    docs = spark.createDataFrame([("UC1", 0, xml), ("UC2", 1, "<feed>")], "channel_id string, source_pos long, xml string")
    assert [(r.channel_id, r.url, r.title) for r in feeds.atom_items(docs).collect()] == [
        ("UC1", "http://v/1", "a"), ("UC1", "http://v/2", "b")]


def test_playlist_caps_before_the_host_test(spark):
    page = json.dumps({"entries": [{"url": "https://x/1"}, {"url": "https://www.tiktok.com/1"}, {"url": None}, {"url": "https://www.tiktok.com/2"}]})
    df = spark.createDataFrame([(0, page), (1, "{oops"), (2, "{}"), (3, None)], "source_pos long, json string")
    assert [(r.source_pos, r.item_pos, r.url) for r in dumps.playlist_entries(df, n=3).collect()] == [(0, 1, "https://www.tiktok.com/1")]
    assert dumps.playlist_entries(df).count() == 2


def test_directory_drops_rows_without_a_feed(spark):
    body = json.dumps({"results": [{"feedUrl": "f", "collectionName": "c"}, {"feedUrl": ""}, {"artistName": "x"}]})
    df = spark.createDataFrame([("q", body)], "query string, json string")
    assert [(r.query, r.feed_url, r.collection, r.publisher) for r in dumps.directory_results(df).collect()] == [("q", "f", "c", None)]


# --- Files -----------------------------------------------------------------

def test_queue_files(spark, tmp_path):
    row = (1, "u", "p", "SCREENED", None, None, None, None, None, None, {"a": "b"})
    df = spark.createDataFrame([row, (2, "v", "p", "REJECTED", None, None, None, None, None, None, None)], QUEUE)
    path = str(tmp_path / "q")
    tables.write_queue(df, path)
    back = tables.read_queue(spark, path).where("status = 'SCREENED'")
    assert back.select("id", "source_metadata").first().asDict() == {"id": 1, "source_metadata": {"a": "b"}}
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
    with pytest.raises(Exception, match="already exists"):
        tables.write_queue(df, path)


def test_queue_files_from_before_a_column_existed(spark, tmp_path):
    spark.createDataFrame([(1, "u")], "id long, url string").write.parquet(str(tmp_path / "old"))
    assert tables.read_queue(spark, str(tmp_path / "old")).first().source_metadata is None


def test_transcript_documents_one_per_file(spark, tmp_path):
    doc = {"id": 7, "url": "u", "platform": "p", "screening_samples": [
        {"chunk_path": "c", "language": "ar", "language_probability": 0.5, "text": "مرحبا",
         "segments": [{"id": 0, "start": 0.0, "end": 1.5, "text": "مرحبا"}]}, {"language": "ar"}]}
    (tmp_path / "clip_1_screening.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2), encoding="utf-8")
    df = transcripts.read_transcripts(spark, str(tmp_path))
    assert df.schema == TRANSCRIPT and df.first().id == 7
    flat = transcripts.flatten_samples(df).orderBy("sample_idx").collect()
    assert [(r.sample_idx, r.text) for r in flat] == [(0, "مرحبا"), (1, None)]
    out = str(tmp_path / "out")
    transcripts.write_transcripts(transcripts.nest_samples(transcripts.flatten_samples(df)), out)
    assert transcripts.read_transcripts(spark, out, multi_line=False).first() == df.first()


def test_contrastive_reads_audio_only_when_needed(spark, tmp_path):
    rows = [("1", "EGY", (bytearray(b"x"),)), ("2", "MSA", (bytearray(),)), ("3", "MSA", None)]
    path = str(tmp_path / "c")
    spark.createDataFrame(rows, "id string, dialect string, audio struct<bytes:binary>").write.parquet(path)
    df = tables.read_contrastive(spark, path)
    assert {r.id: r.has_audio for r in df.collect()} == {"1": True, "2": False, "3": False}
    plan = df.groupBy("dialect").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<dialect:string>" in plan


def test_annotation_csv(spark, tmp_path):
    rows = [(1, "S", "p", None, "lebanese", 'say "hi",\nthere', "2026-01-01T00:00:00"), (2, "S", "p", "a", "skip", None, "t")]
    from cribble.schemas import ANNOTATION

    df = spark.createDataFrame(rows, ANNOTATION)
    path = str(tmp_path / "a")
    annotations.write_annotations(df, path)
    assert sorted(annotations.read_annotations(spark, path).collect()) == sorted(df.collect())


def test_sample_is_written_once(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        annotations.read_sample(spark, path)
    one = spark.createDataFrame([(1, "u", "p", "a", "S", 0)], "id long, url string, platform string, audio_path string, source_status string, pos int")
    assert annotations.write_sample(one, path).first().id == 1
    assert annotations.write_sample(one.withColumn("id", F.lit(2).cast("long")), path).first().id == 1


def test_lexicon_table_keeps_trailing_blanks(spark, tmp_path):
    (tmp_path / "l.csv").write_text('lexicon,term\nstrong,"عم "\nstrong,x\nstrong,x\n', encoding="utf-8")
    assert [r.term for r in tables.read_lexicons(spark, str(tmp_path / "l.csv")).collect()] == ["عم ", "x", "x"]


def test_scratch_is_the_shared_folder(spark):
    assert tables.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


# --- Features and model ----------------------------------------------------

def test_embeddings_blank_text_is_zero(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "  "), (3, None), (4, "b")], "id long, text string")
    out = {r.id: (r.text, r.embedding) for r in embed_text(df, fit_embedder(df, 16)).collect()}
    assert out[2] == ("  ", [0.0] * 16) and out[3] == (None, [0.0] * 16)
    assert sum(x * x for x in out[1][1]) == pytest.approx(1.0)
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, embedding array<float>")
    joined = {r.id: r.embedding for r in attach_embeddings(df, vectors, 2).collect()}
    assert joined == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}


def newton(rows, weights, c):
    """Solve the regularised objective directly on a few columns."""
    import numpy as np

    x = np.array([[1.0, *r[1]] for r in rows])
    y = np.array([r[0] for r in rows], float)
    w = np.array([weights[r[0]] for r in rows])
    beta, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) / c
    penalty[0, 0] = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - y)) + penalty @ beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + penalty
        beta -= np.linalg.solve(hess, grad)
    return beta


def test_training_solves_the_balanced_objective(spark, tmp_path):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(4)
    rows = [(int(rng.random() < .25), [float(v) for v in rng.normal(size=3)]) for _ in range(300)]
    rows = [(y, [x[0] + y, x[1] * 3, x[2]]) for y, x in rows]
    df = spark.createDataFrame(rows, "label int, f array<double>").withColumn("features", array_to_vector("f"))
    model = ml.train_classifier(df, tol=1e-9)
    n = {c: sum(r[0] == c for r in rows) for c in (0, 1)}
    expected = newton(rows, {c: 300 / (2 * n[c]) for c in n}, 1.0)
    got = [model.intercept, *model.coefficients]
    assert np.allclose(got, expected, atol=1e-4)
    default = ml.train_classifier(df)
    assert np.allclose([default.intercept, *default.coefficients], expected, atol=1e-3)
    ml.save_model(model, str(tmp_path / "m"))
    again = ml.load_model(str(tmp_path / "m"))
    assert again.coefficients == model.coefficients
    with pytest.raises(FileNotFoundError):
        ml.load_model(str(tmp_path / "none"))


# --- Streams ---------------------------------------------------------------

CAND = "url string, source_pos long, item_pos long"


def put(spark, folder, rows, schema=CAND):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_drain_takes_up_where_it_stopped(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = spark.createDataFrame([], "id long, status string").schema
    put(spark, src, [(1, "A"), (2, "B")], "id long, status string")
    put(spark, src, [(3, "A")], "id long, status string")
    step = lambda b: b.withColumn("done", F.lit(True))
    drain(spark, src, schema, step, out, ck, files_per_batch=1, status="A")
    assert sorted(r.id for r in read_drained(spark, out).collect()) == [1, 3]
    put(spark, src, [(4, "A")], "id long, status string")
    drain(spark, src, schema, step, out, ck, files_per_batch=1, status="A")
    assert sorted(r.id for r in read_drained(spark, out).collect()) == [1, 3, 4]
    drain(spark, src, schema, step, out, ck)
    assert read_drained(spark, out).count() == 3


def test_dedup_across_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = spark.createDataFrame([], CAND).schema
    put(spark, src, [("a", 1, 0), ("a", 0, 3), ("b", 0, 0)])
    dedup_ingest(spark, src, schema, out, ck, files_per_batch=1)
    put(spark, src, [("a", 0, 0), ("c", 0, 0)])
    put(spark, src, [("c", 5, 0), ("d", 0, 0)])
    dedup_ingest(spark, src, schema, out, ck, files_per_batch=1)
    rows = spark.read.parquet(out).collect()
    assert sorted(r.url for r in rows) == ["a", "b", "c", "d"]
    assert {r.url: r.source_pos for r in rows}["a"] == 0


def run_stream(df, out, ck):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stateful_dedup(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = spark.createDataFrame([], CAND).schema
    put(spark, src, [("a", 0, 0), ("a", 1, 0)])
    for _ in range(2):
        run_stream(distinct_urls(spark.readStream.schema(schema).parquet(src)), out, ck)
        put(spark, src, [("a", 2, 0), ("b", 0, 0)])
    run_stream(distinct_urls(spark.readStream.schema(schema).parquet(src)), out, ck)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_bounded_dedup(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    timed = "url string, at timestamp"
    schema = spark.createDataFrame([], timed).schema
    from datetime import datetime

    put(spark, src, [("a", datetime(2026, 1, 1)), ("a", datetime(2026, 1, 1, 0, 1)), ("b", datetime(2026, 1, 1))], timed)
    run_stream(distinct_urls_within(spark.readStream.schema(schema).parquet(src), "at", "1 hour"), out, ck)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_no_scratch_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert not os.path.exists(os.path.join(root, "spark-warehouse", "cribble"))
