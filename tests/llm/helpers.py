"""Small tables for the corpus operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def docs_of(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def corpus(seed=7):
    """Copies, near copies, shared passages, repeats within a text, null and empty texts, odd white space, null and repeated ids."""
    passage = words(60, 1)
    long = words(3_000, 2)
    changed = long.split()
    changed[1_500] = "other"
    return [
        (1, words(80, 3) + " " + passage), (2, passage + "\n" + words(30, 4)), (3, words(5, 5)), (4, None), (5, ""), (6, " \t\n"), (7, long), (8, long), (9, " ".join(changed)),
        (10, ("x " * 100).strip()), (11, "Ünïcödé wörds here " + words(40, 6)), (12, words(25, 8) + "\r\n\x0b\x0c" + words(25, 8)), (13, words(19, 9)), (14, words(20, 9)), (15, words(20, 9)),
        (None, words(50, 10)), (None, passage), (16, words(30, 11)), (16, words(30, 11)), (16, words(40, 12)),
    ]


def row_set(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))
