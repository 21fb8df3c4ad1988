import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent)]

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, score double, start string, fp string, s int"


def texts():
    """Nulls, empty and very long texts, ties, copies, near copies, shared passages."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = words(60), words(30_000)
    rows = [None, "", " \n\t ", "one", "Two words", "a a a a a a a a a a a a a a a a a a a a a a a a a", long, long[:9000] + " " + words(40), passage]
    rows += [words(rng.randint(1, 25)) + "\n" + passage + "  " + words(rng.randint(20, 60)) for _ in range(6)]
    rows += [words(rng.randint(5, 90)).upper() + "!\n" + "x\nx\n" for _ in range(4)] + ["ab " * 400, "ab " * 401, "é" * 700, "\x1c odd\x00 \u00a0signs # | $"]
    base = words(200)
    rows += [base, base, base + " zz", base.replace("a", "b", 1), words(80)]
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    return [*rows, (None, "one"), (6, " \n\t ")]  # a null id, and a repeated row


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    """Documents with extra columns whose names clash with results."""
    langs, sources = ["en", None, "fr"], ["src0", "src1", None]
    rows = [(d, t, langs[i % 3], sources[i % 2 if i % 7 else 2], 1, 2.0, "x", "y", 3) for i, (d, t) in enumerate(doc_rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i * 3, i % 2, (i // 2) % 2) for i in range(28)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def once(rows):
    """Exact repeats of a row count once."""
    return list(dict.fromkeys(rows))
