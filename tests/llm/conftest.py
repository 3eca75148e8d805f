import pytest

CLASH = "id long, kept boolean, score double, chunk long, key long, node long, row long, text_sha256 string, part long, n long, label long, slot int"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empties, white space, ties, repeated rows, a long text, odd characters, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (0, "a b c d e f"), (1, "a b  c d\te f"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r"), (5, long), (6, long + " tail"), (7, "İ ß é \x1c \u2003 漢字 <|endoftext|> it's"),
        (8, "a b c d e f"), (8, "a b c d e f"), (None, "a b c d e f"), (None, None), (9, "x" * 5000), (10, "the same " * 400),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "CASE WHEN doc_id < 5 THEN 's' END AS source", "CAST(NULL AS long) AS n_chars")
    for c in CLASH.split(", "):
        name, kind = c.split()
        df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(11)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
