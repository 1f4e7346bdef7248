"""Awkward documents that every operator must take."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, batch string, h string, _id string, comp string"


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple]:
    """Null and empty texts, nulls in every column, repeated rows, a long text, other scripts, ties."""
    long = words(6000, 1)
    texts = [None, "", " \n\t ", "one", "a b c d", words(80, 2), words(80, 2), words(80, 2) + " tail", long, "ä ö ü ß " * 30, "日本 語 テスト\n" * 20, "x" * 450, "token = 'abcdefghijklmnop1234'", words(60, 3) + "\n" + words(60, 3)]
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t or ""), "b", "h", "i", "c") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, words(90, 5), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars int")
