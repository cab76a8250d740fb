import re

import pytest

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, size):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(ids, sets, percent=80):
    """Least id reachable over links of whole sets, by brute force."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {i: min(ids[k] for k in range(len(ids)) if find(k) == find(n)) for n, i in enumerate(ids)}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _row long, text_ string, _kept int"

#: Nulls in every column, empty and blank texts, repeated rows, ties, one very long text, odd characters.
ODD = [
    (1, "one two three four five six seven", "en", "a", 33, 9, "x", 1),
    (1, "one two three four five six seven", "en", "a", 33, 9, "x", 1),
    (2, "", "en", "a", 0, 9, "x", 1),
    (3, None, None, None, None, None, None, None),
    (None, "a text without an id that is long enough to hold some words", "fr", None, 5, 1, "y", 2),
    (4, " \t\n ", "de", "b", 4, 1, "y", 2),
    (5, "One Two three four five six seven", "en", "c", 33, 9, "x", 1),
    (6, "é𝄞 ünï ### </turn> \\ <|endoftext|> end", "es", "c", 30, 9, "x", 1),
    (7, "long words " * 40_000, "es", "c", 30, 9, "x", 1),
    (8, "x" * 150_000, "es", "c", 30, 9, "x", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
