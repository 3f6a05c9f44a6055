import pytest

LONG = "word " * 60_000 + "\n" + "The very long text ends here with one more line.\n" * 500

#: nulls, empty and very long texts, ties, repeated rows; every other column may be null and has a clashing name.
EDGE = [
    (1, "A line that is shared by some.\nOwn line of one\n\nshort", "en", "src1"),
    (2, "  a line THAT is shared by some.\t\nOwn line of two\nOwn line of two\nshort", "en", "src1"),
    (2, "  a line THAT is shared by some.\t\nOwn line of two\nOwn line of two\nshort", "en", "src1"),
    (3, None, None, None), (4, "", "en", None), (5, " \n\t\n", None, "src2"), (None, "A line that is shared by some.", "en", "x"),
    (6, LONG, "en", "src0"), (7, LONG, "en", "src0"), (8, "12345 67890 !!", "de", "src9"), (9, "Éa là ß Σς İ ﬁ 漢字 🙂", "fr", "src3"),
    (10, "one two three", "en", "src4"), (11, "ONE two\nthree", "en", "src4"), (None, None, None, None), (2, "another text of two", "en", "src1"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, lang, source, None, "k", 1.0, -1) for i, t, lang, source in EDGE]
    schema = "doc_id long, text string, lang string, source string, n long, key string, score double, sid int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE


@pytest.fixture(scope="session")
def no_docs(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
