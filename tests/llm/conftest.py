import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, bucket int, label string, key string"


def rows(*texts, langs=None, sources=None, start=0):
    """documents with extra columns whose names the operators use themselves."""
    return [(start + i, t, langs[i % len(langs)] if langs else "en", sources[i % len(sources)] if sources else "s0", len(t or ""), "x", 7, "y", "z") for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    return lambda data: spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def odd(docs):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} of the {i}." for i in range(30_000))
    data = rows("", None, "one", "  \n\t ", long, "é ﬁ \U0001f600 ẞ", "same same same", "same same same")
    data += [(6, "same same same", "en", "s0", 14, "x", 7, "y", "z"), (None, "no id here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return docs(data)


@pytest.fixture
def empty(docs):
    return docs([])
