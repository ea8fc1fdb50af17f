import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators add or use inside, as columns of the input.
CLASHING = "doc_id long, text string, shard int, slot long, size long, _key string, score double, predicted int, spans string, kept_text string, n_words long, fp long, component_id long, chunk long, payload binary, start long, ids string"


def edge_texts() -> list:
    """Nulls, empty and blank texts, repeated texts, odd characters and one very long text."""
    base = " ".join(f"word{i % 97} thing{i % 31}" for i in range(400))
    return [None, "", " \t\n ", "one", "one two", base, base, base + " and more words at the end", "é'é 中文 \U0001f600 don't  x\x1c y", "x" * 50_000, " ".join(f"w{i}" for i in range(60_000)), None, ""]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with the edge cases, one row repeated whole, and a null id."""
    rows = [(i, t, "en", "s", None) for i, t in enumerate(edge_texts())]
    rows += [rows[5], (None, "a text without an id, of some words", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    texts = [t for t in edge_texts() if t is None or len(t) < 20_000]
    return spark.createDataFrame([(i, t, 7, 7, 7, "k", 0.5, 1, "s", "kept", 7, 7, 7, 7, b"p", 7, "ids") for i, t in enumerate(texts)], CLASHING)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
