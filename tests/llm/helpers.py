"""Small fixtures and brute-force versions for the operators' tests."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q double, n long, size long, _row string, vid long"


def docs(spark, rows):
    """(doc_id, text, lang, source) rows with extra columns whose names clash with ones that operators use inside."""
    full = [(*r, None if r[1] is None else len(r[1]), 0.5, 1, 2, "x", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 9000
EDGES = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a"), (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (2, None, None, None), (3, "", "en", "b"), (4, " \t\n\x0b\x0c\r ", "de", None), (5, LONG, "en", "a"), (None, "null id text with some words in it and more", "en", "a"),
    (6, "tie tie tie tie tie tie tie tie tie tie", None, "b"), (7, "x", "fr", "c"), (8, "Ünï cödé 日本語 😀 don't 'll <|endoftext|> 12 3", "fr", "c"),
]


def grouped(links, ids):
    """Least id of each id's component."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
