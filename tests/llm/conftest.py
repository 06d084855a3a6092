import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, kept string, n_words long, size long, part int"


def _edge_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Über", "ÉTÉ", "naïve", "汉字", "x#y", "a|b", "don't", "12"]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(None, "null id text here and there", "en", "a"), (1, None, "en", "a"), (2, "", "en", None), (3, " \t\r\n\x0b\x0c ", "de", "b"), (4, "one", None, None), (4, "one", None, None)]
    rows += [(5, "Same\nline\nsame\nSAME\n\nline", "en", "b"), (6, "tab\tand\x1cfield no-break  two", "fr", "b"), (7, "The MIT  License, and\napache LICENSE! GNU General-Public License; mit license", "en", "c")]
    rows += [(8, "\n".join(" ".join(rng.choice(words) for _ in range(11)) for _ in range(1500)), "en", "a")]
    for i in range(30):  # near copies, and lines that ten documents share
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((100 + i, " ".join(copy[:60]) + "\n" + " ".join(copy[60:]) + ("\n  Shared LINE  " if i % 2 else "\nshared line"), "en", "abc"[i % 3]))
    for i in range(25):
        rows.append((200 + i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 9))) + "\nShared line", rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "Z", None])))
    rows += [rows[-1], rows[-1], (300, rows[20][1], "en", "c"), (None, rows[21][1], "en", "c")]
    return [(d, t, lang, s, None if t is None else len(t), 1, "x", 2, 3, 4) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def edge_rows():
    return _edge_rows()


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """Nulls, empty and long texts, ties, repeated rows, extra columns named like what operators add."""
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
