import hashlib
from urllib.parse import urlparse

import pytest

from cribble.functions import media, meta, text, urls
from cribble.settings import AudioLimits
from pyspark.sql import functions as F


def one(spark, expr, **values):
    """Evaluate an expression on one row of the given values."""
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("v")).first().v


URLS = [
    "https://Feeds.Example.com/Show/?a=1#x", "http://e.com", "http://e.com///", "no-scheme/path/",
    "https://e.com/a;p=1?q", "https://e.com/a;b/c;d=2", "ftp://u:p@h.com:21/x/y.MP3", "",
]


@pytest.mark.parametrize("url", URLS)
def test_normalize_feed(spark, url):
    p = urlparse(url)
    expected = f"{p.scheme}://{p.netloc}{p.path}".rstrip("/").lower() if url else ""
    got = one(spark, urls.normalize_feed("u"), u=url)
    assert got == (expected if p.scheme else expected.removeprefix("://"))


def test_normalize_feed_null(spark):
    assert one(spark, urls.normalize_feed("u"), u=None) == ""


@pytest.mark.parametrize("url", [u for u in URLS if "://" in u])
def test_site_root(spark, url):
    p = urlparse(url)
    assert one(spark, urls.site_root("u"), u=url) == f"{p.scheme}://{p.netloc}"


@pytest.mark.parametrize("url,blocked", [
    ("https://www.BUZZSPROUT.com/1.mp3", True), ("https://x.com/buzzsprout.com/1.mp3", False),
    ("//buzzsprout.com/a", True), ("buzzsprout.com/a", False), (None, False),
])
def test_host_blocked(spark, url, blocked):
    assert one(spark, urls.host_blocked("u"), u=url) is blocked


@pytest.mark.parametrize("url,audio", [
    ("http://a/b.MP3", True), ("http://a/b.mp3?x=1", False), ("http://a/b.aac", False), ("x.ogg", True),
    ("", False), (None, False),
])
def test_is_audio_url(spark, url, audio):
    assert one(spark, urls.is_audio_url("u"), u=url) is audio


def test_is_short(spark):
    assert one(spark, urls.is_short("u"), u="https://y.com/shorts/1")
    assert not one(spark, urls.is_short("u"), u=None)


@pytest.mark.parametrize("url,ext", [
    ("http://a/b.MP3", ".mp3"), ("http://a/b.aac?x=.wav", ".aac"), ("http://a/b.flac", ".mp3"),
    ("http://a/", ".mp3"), ("http://a/.wav", ".mp3"), ("http://a/b.wav/", ".wav"), ("http://a/b.ogg;v=1", ".ogg"),
])
def test_stable_name(spark, url, ext):
    digest = hashlib.sha1(url.encode()).hexdigest()
    assert one(spark, urls.stable_name("u"), u=url) == f"podcast_{digest}{ext}"


@pytest.mark.parametrize("url,name", [
    ("https://www.Tik.com:443/@u/video/12.3", "www_tik_com_12_3"), ("https://h.com/", "h_com_tiktok"),
    ("https://u:p@h.com/a/", "h_com_a"), ("nothing", "tiktok_nothing"),
])
def test_url_basename(spark, url, name):
    assert one(spark, urls.url_basename("u"), u=url) == name


@pytest.mark.parametrize("tag,joined,kept", [
    (" #Be irut ", "beirut", "be irut"), ("@A#b", "ab", "ab"), ("\tx y\n", "xy", "x y"),
])
def test_normalize_tag(spark, tag, joined, kept):
    assert one(spark, urls.normalize_tag("t"), t=tag) == joined
    assert one(spark, urls.normalize_tag("t", keep_blanks=True), t=tag) == kept


@pytest.mark.parametrize("token,useless", [
    ("abc", True), ("abcd", False), ("12345", True), ("٣٤٥٦", True), ("video", True), (None, True),
])
def test_useless_token(spark, token, useless):
    assert one(spark, urls.useless_token("t"), t=token) is useless


def test_relevant_feed(spark):
    assert one(spark, urls.relevant_feed("l", "t"), l="AR-lb", t="x")
    assert one(spark, urls.relevant_feed("l", "t"), l="en", t="The Lebanese hour")
    assert one(spark, urls.relevant_feed("l", "t"), l="en", t="راديو لبنان")
    assert not one(spark, urls.relevant_feed("l", "t"), l=None, t=None)


def entry(spark, enclosures, links):
    return spark.createDataFrame(
        [(enclosures, links)],
        "enclosures array<struct<url:string,href:string>>, links array<struct<href:string>>")


def test_pick_audio_url(spark):
    def pick(enclosures, links, **kw):
        return entry(spark, enclosures, links).select(
            urls.pick_audio_url("enclosures", "links", **kw)).first()[0]

    assert pick([("a.jpg", None), ("b.MP3", None)], [("c.mp3",)]) == "b.MP3"
    assert pick([("a.jpg", None)], [("x.html",), ("c.mp3",)]) == "c.mp3"
    assert pick([], []) is None
    assert pick([(None, "h.mp3")], [("c.mp3",)]) == "c.mp3"
    assert pick([(None, "h.mp3")], [("c.mp3",)], enclosure_href=True) == "h.mp3"
    assert pick([("", "h.mp3")], [], enclosure_href=True) == "h.mp3"


def test_pick_first_enclosure(spark):
    def pick(enclosures):
        return entry(spark, enclosures, []).select(urls.pick_first_enclosure("enclosures")).first()[0]

    assert pick([(None, "a.pdf"), (None, "b.mp3")]) == "a.pdf"
    assert pick([(None, ""), (None, "b.mp3")]) is None
    assert pick([]) is None


def test_three_kinds_of_empty_metadata(spark):
    df = spark.createDataFrame([(None,), ("null",), ("{}",), ('{"a": "1"}',), ('{"a": null}',)], "j string")
    m = df.select(meta.parse_metadata("j").alias("m"))
    got = m.select(meta.meta_present("m"), meta.meta_usable("m"), meta.json_field("m", "a")).collect()
    assert [tuple(r) for r in got] == [
        (False, False, None), (True, False, None), (True, False, None), (True, True, "1"), (True, True, None)]


@pytest.mark.parametrize("platform,duration,status,kept", [
    ("youtube", 5.0, "SKIPPED_LENGTH", None), ("youtube", 6.0, "DOWNLOADED", 6.0),
    ("youtube", 1201.0, "DOWNLOADED", 1200.0), ("podcast", 1200.0, "DOWNLOADED", 1200.0),
    ("podcast", 1200.5, "ERROR_DOWNLOAD", None), ("podcast_rss", 5.9, "SKIPPED_LENGTH", None),
    ("tiktok", 1201.0, "DOWNLOADED", 1201.0), ("tiktok", 1201.5, "DOWNLOADED", 1200.0),
])
def test_duration_gate(spark, platform, duration, status, kept):
    g = one(spark, media.duration_gate("p", "d"), p=platform, d=duration)
    assert (g.status, g.duration_seconds) == (status, kept)
    if status == "ERROR_DOWNLOAD":
        assert g.error_msg == f"Podcast too long ({duration:.1f}s > 1200s)"


def test_chunk_plan(spark):
    df = spark.range(500).select("id", (F.col("id") / 4).alias("d"))
    rows = df.select("id", "d", F.explode(media.chunk_plan("id", "d")).alias("c")).collect()
    for r in rows:
        assert 0 <= r.c.start <= max(0, int(r.d - 20))
    assert {sum(1 for r in rows if r.id == i) for i in range(80)} == {1}
    assert {sum(1 for r in rows if r.id == i) for i in range(80, 500)} == {3}
    again = df.select("id", "d", F.explode(media.chunk_plan("id", "d")).alias("c")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("total,start", [(0.0, None), (-1.0, None), (30.0, 0.0), (70.0, 10.0), (1000.0, 300.0)])
def test_clip_start(spark, total, start):
    assert one(spark, media.clip_start("t"), t=total) == start


def test_limits_are_parameters(spark):
    g = one(spark, media.duration_gate("p", "d", AudioLimits(min_seconds=1, max_seconds=10)), p="podcast", d=11.0)
    assert g.error_msg == "Podcast too long (11.0s > 10s)"


@pytest.mark.parametrize("value,shown", [
    (None, "(no transcript available)"), ("", "(empty transcript)"), (" \n", "(empty transcript)"),
    (" ab ", "ab"), ("x" * 700, "x" * 600), (" " * 600 + "y", "(empty transcript)"),
])
def test_excerpt(spark, value, shown):
    assert one(spark, text.excerpt("t"), t=value) == shown


def test_top_class_ties_and_softmax(spark):
    df = spark.createDataFrame([({"b": 1.0, "a": 1.0, "c": 0.0},), ({"x": -700.0, "y": 700.0},)], "m map<string,double>")
    rows = [r[0] for r in df.select(text.top_class(text.softmax("m"))).collect()]
    assert (rows[0].top, rows[1].top) == ("A", "Y")
    assert rows[1].top_score == pytest.approx(1.0)


def samples(spark, rows):
    return spark.createDataFrame([(rows,)], "s array<struct<language:string,language_probability:double,text:string>>")


@pytest.mark.parametrize("rows,passed,probability", [
    ([], False, 0.0), ([("en", 0.9, "x")], False, 0.0), ([("ar", 0.70, "x")], True, 0.7),
    ([("ar", 1.0, "x"), ("ar", None, "y")], False, 0.5), ([("ar", 0.6999, "x")], False, 0.7),
    ([("ar", 0.8, "x"), ("en", 0.0, "y"), ("ar", 0.6, "z")], True, 0.7), (None, False, 0.0),
])
def test_language_gate(spark, rows, passed, probability):
    g = samples(spark, rows).select(text.language_gate("s")).first()[0]
    assert (g.passed, g.probability) == (passed, probability)


def test_transcript_text_keeps_empty_slots(spark):
    df = samples(spark, [("ar", 1.0, "a"), ("ar", 1.0, None), ("ar", 1.0, "b")])
    assert df.select(text.transcript_text("s")).first()[0] == "a  b"


@pytest.mark.parametrize("platform, raw, tag, useless", [
    ("facebook", " @My Page#", "mypage", False), ("facebook", "tv", "tv", True), ("facebook", "News", "news", True),
    ("facebook", "abc", "abc", False), ("facebook", "123", "123", True), ("facebook", "", "", True),
    ("instagram", " #My Reel ", "my reel", False), ("instagram", "REELS", "reels", True), ("instagram", "abc", "abc", True),
    ("tiktok", "#My Tag", "mytag", False), ("tiktok", "abc", "abc", True), ("tiktok", "#FYP", "fyp", True),
])
def test_tags_by_platform(spark, platform, raw, tag, useless):
    df = spark.createDataFrame([(raw,)], "token string").select(urls.platform_tag("token", platform).alias("t"))
    row = df.select("t", urls.useless_platform_tag("t", platform).alias("u")).first()
    assert (row.t, row.u) == (tag, useless)


def test_growing_a_source_list(spark):
    from cribble.operators.discover import grow_source_list

    def column(*tokens):
        return spark.createDataFrame([(x,) for x in tokens], "token string")

    listed, seeds = column("#Old", "tv", None), column("New Page", "old", "live", "ab", "Taken!", "777")
    got = grow_source_list(listed, seeds, "facebook", column("taken!"))
    assert [r.token for r in got.collect()] == ["", "newpage", "old", "tv"]
