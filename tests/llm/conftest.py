import pytest

from cribble.llm.shared import clear_scratch


@pytest.fixture(scope="session", autouse=True)
def scratch_is_cleared(spark):
    yield
    clear_scratch(spark)


#: Rows that every operator on transcripts has to take: nulls in any column, an empty and a
#: long text, a repeated row, an id used twice, and columns named like results.
LONG = " ".join(f"wort{i % 977}x{i % 31}" for i in range(30_000))
MESSY = [
    (1, "Eine Zeile mit genug Zeichen\nzweite Zeile auch lang genug", "a"),
    (1, "Eine Zeile mit genug Zeichen\nzweite Zeile auch lang genug", "a"),
    (2, None, None),
    (None, "", "a"),
    (None, None, None),
    (3, "", None),
    (4, " \t\n\x0b ", "b"),
    (5, LONG, "a"),
    (6, LONG + " Ende", "b"),
    (7, "äöü ß 漢字 🙂 Eine Zeile mit genug Zeichen", "b"),
    (7, "ein anderer Text unter der gleichen Nummer", "b"),
]
SCHEMA = "id bigint, text string, source string"


@pytest.fixture(scope="session")
def messy(spark):
    extra = "*, 1 AS n_words, 'x' AS kept, 2 AS part, 3 AS row, 4 AS token, 5 AS component, 6 AS size, 'y' AS language, 7 AS v, 8 AS n"
    return spark.createDataFrame(MESSY, SCHEMA).selectExpr(*extra.split(", ")).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
