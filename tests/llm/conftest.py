import random

import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, row string, `__id` string"


def odd_documents(seed=0, n=60):
    """Documents with nulls, empty, blank and very long texts, repeats, near copies and shared lines; no id repeats."""
    own = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "straße", "niño", "İx", "ΑΣ", "a.b", "it's", "％"]
    shared = ["This line is shared by many of the documents", "Another SHARED line of good length\t", "short"]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(own.randint(1, 6)):
            lines.append(own.choice(shared) if own.random() < 0.3 else " ".join(own.choices(words, k=own.randint(1, 40))))
        docs.append("\n".join(lines))
    base = " ".join(own.choices(words, k=200))
    docs += [base, base, base.upper(), " " + base + "  x", base.replace("w1 ", "v1 ", 1), base + " tail end"]
    docs += [None, "", " \t\n\r\x0b\x0c ", "\n\n", "one", "12 34 %%", "\x1c\x85", " ".join(own.choices(words, k=30000))]
    sources = ["b", "a", None, "Z", "é"]
    rows = []
    for i, t in enumerate(docs):
        lang = own.choice(["en", "fr", None])
        rows.append(Row(doc_id=i * 3 - 5, text=t, lang=lang, source="a" if i % 3 else own.choice(sources), n_chars=len(t or ""), size=-1, rank=-1, row="r", __id="x"))
    own.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd_rows():
    return odd_documents()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def with_repeats(spark):
    """The same with a null id, a row that repeats exactly and an id with two texts."""
    rows = odd_documents()
    extra = [rows[0], rows[0], Row(**{**rows[1].asDict(), "doc_id": None}), Row(**{**rows[2].asDict(), "text": "other text of the same id"})]
    return spark.createDataFrame(rows + extra, SCHEMA).repartition(4)
