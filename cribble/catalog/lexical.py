"""Lexicon matching and scoring over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.catalog.registry import Tables, query
from cribble.functions.lexicon import Lexicons, count_matches, final_score, lexicon_score
from cribble.functions.lexicon import dominance_ratio
from cribble.operators.labels import tier, verified_positive
from cribble.operators.lexhits import count_matches_table, count_terms, gram_join_hits, lexicon_hits
from cribble.operators.features import score_texts

# Short lists in the languages of the driver's documents. One entry is listed
# twice, one ends in a blank, one has upper case and so never matches.
LISTS = {
    "lb": ["le", "la", "les", "des", "un ", "que", "le"],
    "msa": ["the", "and", "of the", "tion", "ing"],
    "egy": ["der", "den", "und "],
    "gulf": ["el ", "los", "que"],
    "sy": ["las", "en ", "le"],
    "strong_lb_hits": ["eaux", "ou ", "ière", "The"],
}
LEX = Lexicons.from_lists(LISTS)


def counts_sql(text: str) -> str:
    return ", ".join(
        "(" + " + ".join(f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in ws)
        + f") AS {name}"
        for name, ws in LISTS.items()
    )


def scored_sql(source: str, key: str, text: str = "text") -> str:
    """CTEs ``lexed`` (counts) and ``scored`` (all nine fields) over ``source(key, text)``."""
    return f"""
lexed AS (SELECT {key}, {counts_sql(f"lower(coalesce({text}, ''))")} FROM {source}),
ratioed AS (SELECT *, CASE WHEN lb + msa > 0 THEN CAST(msa AS DOUBLE) / (lb + msa) ELSE 0e0 END
  AS ratio FROM lexed),
rawed AS (SELECT *, lb * 1.8e0 - msa * 0.6e0 - egy * 1.0e0 - gulf * 1.0e0 - sy * 0.5e0
  - CASE WHEN ratio >= 0.60e0 THEN msa * 0.7e0 ELSE 0e0 END AS raw_score FROM ratioed),
scored AS (SELECT *, round(ratio, 3) AS msa_ratio_core,
  greatest(0e0, least(1e0, raw_score / 5.0e0)) AS lexicon_score FROM rawed)"""


SCORED_DOCS = "WITH" + scored_sql("documents", "doc_id")


@query("entry", f"""{SCORED_DOCS}
SELECT d.source, CASE WHEN lexicon_score >= 0.75e0 THEN 'POTENTIAL_LB'
  WHEN lexicon_score >= 0.50e0 THEN 'BORDERLINE_LB' ELSE 'REJECTED' END AS tier,
  count(*) AS n, sum(lb) AS lb_total, round(avg(raw_score), 6) AS mean_raw
FROM scored s JOIN documents d ON s.doc_id = d.doc_id GROUP BY 1, 2""".replace(
    "sum(lb) AS", "CAST(sum(lb) AS BIGINT) AS"))
def tiers_by_source(t: Tables) -> DataFrame:
    d = F.col("d")
    scored = t.texts.select("source", lexicon_score("text", LEX).alias("d"))
    return scored.groupBy("source", tier(d["lexicon_score"]).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d["lb"]).alias("lb_total"),
        F.round(F.avg(d["raw_score"]), 6).alias("mean_raw"),
    )


@query("F1", f"WITH x AS (SELECT doc_id, {counts_sql('lower(text)')} FROM documents) SELECT * FROM x")
def count_matches_builtin(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", count_matches("text", LEX, "builtin").alias("c")).select(
        "doc_id", "c.*"
    )


@query("F1", f"WITH x AS (SELECT doc_id, {counts_sql('lower(text)')} FROM documents) SELECT * FROM x")
def count_matches_arrow(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", count_matches("text", LEX, "arrow").alias("c")).select(
        "doc_id", "c.*"
    )


@query("F2, F4", f"""{SCORED_DOCS} SELECT doc_id, lb, msa, egy, gulf, sy, strong_lb_hits,
msa_ratio_core, round(raw_score, 6) AS raw_score, round(lexicon_score, 6) AS lexicon_score FROM scored""")
def lexicon_details(t: Tables) -> DataFrame:
    d = t.texts.select("doc_id", lexicon_score("text", LEX).alias("d")).select("doc_id", "d.*")
    return d.withColumns({
        "raw_score": F.round("raw_score", 6), "lexicon_score": F.round("lexicon_score", 6),
    })


@query("F3", f"""{SCORED_DOCS} SELECT doc_id, round(ratio, 6) AS ratio, ratio >= 0.60e0 AS dominated
FROM scored""")
def dominance(t: Tables) -> DataFrame:
    c = t.texts.select("doc_id", count_matches("text", LEX).alias("c"))
    ratio = dominance_ratio(F.col("c.lb"), F.col("c.msa"))
    return c.select("doc_id", F.round(ratio, 6).alias("ratio"), (ratio >= 0.60).alias("dominated"))


@query("F5", f"""{SCORED_DOCS} SELECT doc_id, round(lexicon_score, 6) AS final_score,
round(lexicon_score, 6) AS lex_score, strong_lb_hits, CAST(NULL AS VARCHAR) AS adi FROM scored""")
def final_scores(t: Tables) -> DataFrame:
    f = t.texts.select("doc_id", final_score("text", LEX).alias("f"))
    return f.select(
        "doc_id", F.round("f.final_score", 6).alias("final_score"),
        F.round("f.lex_score", 6).alias("lex_score"),
        F.col("f.lexicon_details.strong_lb_hits").alias("strong_lb_hits"),
        F.col("f.adi").alias("adi"),
    )


@query("P17", f"{SCORED_DOCS} SELECT doc_id, strong_lb_hits FROM scored WHERE strong_lb_hits >= 1")
def verified_positives(t: Tables) -> DataFrame:
    scored = score_texts(t.texts.select("doc_id", "text"), LEX)
    return verified_positive(scored).select(
        "doc_id", F.col("diagnostics.lexicon_details.strong_lb_hits").alias("strong_lb_hits")
    )


# A term table that grows with the data: every word of the benchmark passages,
# each occurrence a list entry.
WORDS_SQL = """words AS (SELECT CASE length(w) % 5 WHEN 0 THEN 'lb' WHEN 1 THEN 'msa' WHEN 2 THEN 'egy'
WHEN 3 THEN 'gulf' ELSE 'sy' END AS lexicon, w AS term FROM (
SELECT unnest(string_split(replace(lower(text), chr(10), ' '), ' ')) AS w FROM benchmark)
WHERE length(w) > 2)"""


def benchmark_words(t: Tables) -> DataFrame:
    names = F.create_map(*[
        x for i, n in enumerate(["lb", "msa", "egy", "gulf", "sy"]) for x in (F.lit(i), F.lit(n))
    ])
    words = t.benchmark.select(F.explode(
        F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")).alias("term"))
    return words.where(F.char_length("term") > 2).select(
        F.get(F.map_values(F.map_filter(names, lambda k, v: k == F.char_length("term") % 5)), 0)
        .alias("lexicon"), "term",
    )


@query("F1, F2", f"""WITH {WORDS_SQL}, m AS (SELECT term, lexicon, count(*) AS n FROM words GROUP BY 1, 2),
h AS (SELECT d.doc_id, m.lexicon, m.n FROM documents d JOIN m ON contains(lower(d.text), m.term))
SELECT d.doc_id,
{", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE lexicon = '{x}'), 0) AS INT) AS {x}" for x in ("lb", "msa", "egy", "gulf", "sy"))}
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY 1""")
def count_matches_large_lists(t: Tables) -> DataFrame:
    lex = Lexicons.from_table(benchmark_words(t), ["lb", "msa", "egy", "gulf", "sy"])
    return t.texts.select("doc_id", count_matches("text", lex).alias("c")).select("doc_id", "c.*")


# A still larger one: every stretch of four words of the benchmark passages, and of seven.
PHRASES_SQL = """ws AS (SELECT list_filter(string_split(replace(lower(text), chr(10), ' '), ' '), lambda w: w <> '') AS w FROM benchmark),
phrases AS (SELECT CASE WHEN k = 4 THEN 'lb' ELSE 'msa' END AS lexicon, array_to_string(w[i:i + k - 1], ' ') AS term
FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (SELECT unnest([4, 7]) AS k) WHERE len(w) >= k))"""


def benchmark_phrases(t: Tables) -> DataFrame:
    words = F.filter(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
    cut = t.benchmark.select(words.alias("w")).select("w", F.explode(F.array(F.lit(4), F.lit(7))).alias("k"))
    places = F.when(F.size("w") >= F.col("k"), F.sequence(F.lit(1), F.size("w") - F.col("k") + 1))
    return cut.select("w", "k", F.explode(places).alias("i")).select(
        F.when(F.col("k") == 4, "lb").otherwise("msa").alias("lexicon"),
        F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("term"))


COUNTED_PHRASES_SQL = f"""WITH {PHRASES_SQL}, m AS (SELECT term, lexicon, count(*) AS n FROM phrases GROUP BY 1, 2),
h AS (SELECT d.doc_id, m.lexicon, m.n FROM documents d JOIN m ON contains(lower(d.text), m.term))
SELECT d.doc_id, {", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE lexicon = '{x}'), 0) AS INT) AS {x}" for x in ("lb", "msa"))}
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY 1"""


@query("F1, J10", COUNTED_PHRASES_SQL)
def count_phrases(t: Tables) -> DataFrame:
    counted = count_matches_table(t.texts.select("doc_id", "text"), benchmark_phrases(t), ["lb", "msa"], "doc_id")
    return counted.select("doc_id", "counts.*")


@query("F1, J10", COUNTED_PHRASES_SQL)
def count_phrases_by_join(t: Tables) -> DataFrame:
    """As for a table that no driver could hold."""
    counted = count_matches_table(t.texts.select("doc_id", "text"), benchmark_phrases(t), ["lb", "msa"], "doc_id", max_terms=0)
    return counted.select("doc_id", "counts.*")


HITS_SQL = f"""WITH {WORDS_SQL}, m AS (SELECT term, lexicon, count(*) AS multiplicity FROM words GROUP BY 1, 2)
SELECT d.doc_id, m.lexicon, m.term, m.multiplicity FROM documents d
JOIN m ON contains(lower(d.text), m.term)"""


@query("J10", HITS_SQL)
def lexicon_term_hits(t: Tables) -> DataFrame:
    return lexicon_hits(t.texts, benchmark_words(t), "doc_id")


@query("J10", HITS_SQL)
def lexicon_term_hits_by_join(t: Tables) -> DataFrame:
    return gram_join_hits(t.texts, count_terms(benchmark_words(t)), "doc_id")
