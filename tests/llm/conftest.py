import pytest

#: Rows with every odd case: nulls in any column, empty and blank texts, ties, repeated rows; columns with names that operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, h long, words string, size long, shard long, node string"


def doc(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, 0.5, 1, "x", 3, 2, "n")


def long_text(seed, n):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 5003}" for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    base = long_text(1, 120)
    rows = [
        doc(1, base), doc(2, base + " "), doc(3, base.replace(" ", "\n")), doc(4, base), doc(4, base),
        doc(5, None), doc(6, ""), doc(7, "  \t\n"), doc(8, "one"), doc(None, "two words"), doc(None, None, None, None),
        doc(9, long_text(2, 20_000), "fr", "b"), doc(10, long_text(3, 300), None, None), doc(11, long_text(4, 90), "de", "b"),
        doc(12, "été ß 日本語 🙂 <|endoftext|> " * 5, "fr", "é"), doc(13, "AAA $$$ ### 111\nAAA $$$ ### 111\nb", "de", ""), doc(14, long_text(4, 90) + " more", "de", "b"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
