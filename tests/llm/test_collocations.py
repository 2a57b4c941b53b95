"""Collocations against SQL, a plain Python version and hand cases."""

import random
import re
from collections import Counter

import duckdb
import pytest

from splitline.llm import collocations
from splitline.llm.registry import op13_phrase_collocations

from .helpers import DOCS, docs_of


def plain(rows, max_n=3, floor=10, inside=50, top=2000):
    """rows: (lang, text). Tuples (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_n + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    out = []
    wanted = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= floor}
    for (lang, p), a in wanted.items():
        if any(q[0] == lang and len(q[1]) > len(p) and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) and 100 * b >= inside * a for q, b in wanted.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    got, place = [], Counter()
    for lang, score, a, p, l, r in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            got.append((lang, place[lang], p.decode(), -a, l, r, n[lang], -score))
    return got


def tuples(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"max_n": 4, "floor": 3, "inside": 70}, {"max_n": 2, "floor": 2, "top": 3}])
def test_random_texts(spark, options):
    r = random.Random(5)
    words = ["a", "B", "the", "é", "New", "york", "City", "über", "x-1", " y", "ß"]
    rows = [(r.choice(["en", "fr", None, "und", ""]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!", "\r\n"]) for _ in range(r.randrange(90)))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("fr", " .\t. "), ("en", "new york city " * 40)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], DOCS)
    assert tuples(collocations.collocations(docs, **options)) == sorted(plain(rows, **options))


def test_ties_copies_and_dropped_extensions(spark):
    # every word is met 10 times: ties of score and count go by the phrase's bytes; "b c d" holds "b c" and "c d"
    rows = [(i, "z y. b c d. É f") for i in range(10)]
    got = [(r.phrase, r.score, r["rank"]) for r in collocations.collocations(docs_of(spark, rows)).orderBy("rank").collect()]
    assert got == [("b c d", 1_000_000, 1), ("z y", 1_000_000, 2), ("É f", 1_000_000, 3)]
    more = [*rows, *((100 + i, "b c") for i in range(11))]  # 10 of 21 are inside: under a half, so "b c" stays
    assert {r.phrase for r in collocations.collocations(docs_of(spark, more)).collect()} == {"b c", "b c d", "z y", "É f"}
    assert collocations.collocations(docs_of(spark, rows[:9])).count() == 0


def test_products_beyond_64_bits_are_exact(spark):
    big = 3_037_000_501
    known = spark.createDataFrame([("en", "a b", big - 1, 2), ("en", "a", big, 1), ("en", "b", 4 * big, 1)], "lang string, phrase string, f long, size int")
    got = collocations.scored(known, known.where("size = 2").withColumnRenamed("f", "a")).first()
    assert (got.l, got.r, got.score) == (big, 4 * big, 10**6 * (big - 1) ** 2 // (4 * big * big))


def test_whole_tables_against_sql(spark, sf):
    for folder in (sf, "/root/testdata/sf0.01"):
        c = duckdb.connect()
        c.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
        want = sorted(c.sql(collocations.ORACLE).fetchall())
        assert want and tuples(op13_phrase_collocations(spark, folder)) == want


def test_long_texts_empty_tables_and_clashing_columns(spark):
    text = ("lorem ipsum dolor " * 60_000) + "x" * 300_000
    docs = docs_of(spark, [(1, text), (None, "a"), (1, text)])
    names = ["phrase", "words", "word", "i", "piece", "f", "a", "l", "r", "n", "score", "rank", "size", "k"]
    clash = docs.selectExpr("*", *[f"{j} as {c}" for j, c in enumerate(names)])
    assert tuples(collocations.collocations(docs)) == tuples(collocations.collocations(clash)) != []
    assert collocations.collocations(docs.limit(0)).count() == 0
