"""URL rules and models on odd rows."""

from collections import Counter
from math import log

import pytest

from cribble.llm.queries import URL_RULES
from cribble.llm.url_filter import gram_counts, language_model, url_verdicts

ROWS = [
    (1, "http://WWW.Example.ORG/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
    (2, "https://example.org/en/17?x#y", "example.org", "/en/17", "example.org/en/1", "block"),
    (3, "ftp://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (4, "a://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    (5, "a://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    (6, "a://x.com/fr", "x.com", "/fr", None, None),
    (7, "a://org", "org", "", None, None),
    (8, "http://a.net?u=b://c.org/", "a.net", "", None, None),
    (9, "no scheme", "", "", None, None), (10, None, "", "", None, None), (11, "", "", "", None, None),
    (None, "://é.org/\nx", "é.org", "/\nx", "org/", "allow"), (12, "x://a.org/b://d.com/", "a.org", "/b://d.com/", "org/", "allow"),
    (1, "http://WWW.Example.ORG/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
]


def test_rules(spark):
    df = spark.createDataFrame([r[:2] for r in ROWS], "id bigint, url string").selectExpr("*", "1 AS score", "2 AS host", "3 AS cut")
    got = sorted(((r.id, r.host, r.path, r.rule) for r in url_verdicts(df, URL_RULES).collect()), key=str)
    assert got == sorted(((r[0], *r[2:5]) for r in ROWS), key=str)
    verdicts = {r.id: r.verdict for r in url_verdicts(df, URL_RULES).collect()}
    assert all(verdicts[r[0]] == r[5] for r in ROWS if r[5]) and set(verdicts.values()) <= {"allow", "block"}


def test_model_tells_urls_apart(spark):
    good = [(i, f"http://news{i}.org/story/{i * 7}") for i in range(150)]
    bad = [(1000 + i, f"http://casino{i}.com/de/spin?win={i * 11}") for i in range(150)]
    new = [(2000, "http://news-site.net/story/99"), (2001, "http://casino-x.net/spin?win=99")]
    df = spark.createDataFrame(good + bad + new, "id bigint, url string")
    got = {r.id: r for r in url_verdicts(df, URL_RULES).collect()}
    assert got[2000].verdict == "allow" and got[2001].verdict == "block"
    assert got[2000].score > got[2000].cut > got[2001].score


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "id bigint, url string")
    row = url_verdicts(df, URL_RULES).first()
    assert (row.verdict, row.score, row.cut) == ("allow", 0, 0)
    assert url_verdicts(df.limit(0), URL_RULES).count() == 0
    assert url_verdicts(df, ()).first().rule is None


def test_model_against_brute_force(spark):
    """Every probability by counting substrings, on URLs with characters beyond ASCII and a repeated row."""
    rows = [("a.de/äöü", True), ("a.de/äö🙂", True), ("a.de/äöü", True), ("b.de/xöü", False), ("漢字.de", None), ("", True), (None, False)]
    pad = {c: ["\n" * 5 + (u or "") for u, x in rows if x is c] for c in (True, False)}

    def prob(gram, k, texts):
        """Of the last character of ``gram`` after the ``k`` before it."""
        if k < 0:
            return 1 / 1114112
        seen = Counter(t[i - k: i + 1] for t in texts for i in range(5, len(t)) if t[i - k: i] == gram[5 - k: 5])
        m, t = sum(seen.values()), len(seen)
        return (seen[gram[5 - k:]] + t * prob(gram, k - 1, texts)) / (m + t) if m else prob(gram, k - 1, texts)

    frame = spark.createDataFrame(rows, "url string, accepted boolean")
    got = {r.gram: (r.n, r.ratio) for r in language_model(gram_counts(frame)).collect()}
    every = Counter(t[i: i + 6] for u, _ in rows for t in ["\n" * 5 + (u or "")] for i in range(len(t) - 5))
    assert {g: n for g, (n, _) in got.items()} == every
    for gram, (_, ratio) in got.items():
        assert ratio == pytest.approx(1e6 * (log(prob(gram, 5, pad[True])) - log(prob(gram, 5, pad[False]))), abs=1)


def test_hosts_beyond_ascii_score_differently(spark):
    """Two hosts of one shape: what is learned of one says nothing of the other."""
    good = [(i, f"http://новости{i}.org/") for i in range(40)]
    bad = [(100 + i, f"http://подарки{i}.com/de/") for i in range(40)]
    new = [(200, "http://новости.net/"), (201, "http://подарки.net/"), (202, "http://漢字" + "x" * 200_000)]
    got = {r.id: r for r in url_verdicts(spark.createDataFrame(good + bad + new, "id bigint, url string"), URL_RULES).collect()}
    assert got[200].score > got[201].score and len(got) == 83
    assert got[200].verdict == "allow" and got[201].verdict == "block"


def test_no_python(spark):
    from cribble.llm.queries import queries

    for name in ("op2_quality_rules", "op10_url_filters"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian")), plan


@pytest.mark.parametrize("n", [1])
def test_queries_are_registered(n):
    import __spark_entry__ as entry

    found = [k for k in entry.queries() if k.startswith("op")]
    assert [int(k[2:].split("_")[0]) for k in found] == list(range(1, 14)) and "pipeline" in entry.queries()
