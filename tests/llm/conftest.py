import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, row string, keys int"


def make(spark, texts, start=0):
    """Documents from texts (or (id, text, source)), with further columns whose names clash with the operators' own."""
    rows = [t if isinstance(t, tuple) else (start + i, t, f"src{i % 4}") for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "r", 2) for i, t, s in rows], SCHEMA)


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + k * 104729) % 100003}" for k in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text and characters of all widths."""
    long = words(5, 60_000)
    near = words(9, 200).split(" ")
    texts = [None, "", " \n\t", "a", "A a", words(1, 50), words(1, 50) + "\n", words(2, 50), long, "é 日本 😀 x", " ".join(near), " ".join(near[:190] + ["x"] * 10), 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end']
    rows = [(i, t, f"src{i % 4}") for i, t in enumerate(texts)]
    return make(spark, [*rows, rows[5], (None, "no id", None), (None, None, "src1")]).repartition(3)
