import pytest

LONG = "la " * 30_000 + "fin"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null and empty texts, ties, repeated rows, a very long text, and columns with clashing names."""
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [
        (1, "one two three", "a"), (2, "one two three", "b"), (3, None, "c"), (4, "", None), (4, "", None), (5, "   \n\t ", "e"), (6, LONG, "f"), (7, LONG, "g"),
        (8, passage + " tail", "h"), (9, "head " + passage, "i"), (9, "head " + passage, "i"), (None, "one two three", "j"), (None, None, None), (10, "Ünï cödé 日本語 \U0001f600", "k"),
        (11, "word", "l"), (12, "ONE two THREE", "m"),
    ]
    clashing = ["digest", "print", "label", "id", "keep_id", "kept", "score", "size", "item_id", "key", "n", "u", "v", "row", "first", "mark"]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for k, name in enumerate(clashing):
        df = df.selectExpr("*", f"'{k}' AS `{name}`")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
