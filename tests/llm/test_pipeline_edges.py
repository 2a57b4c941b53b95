"""Empty tables, nulls, long texts and clashing columns through every corpus operator and stage."""

import pytest

import corpus_pipeline
from splitline.llm import decontam, katz, nearjoin, pieces, pii, quality, repair, substring

from .helpers import corpus, docs_of, row_set, words

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def tables(spark, path, rows, labels=(), items=()):
    docs_of(spark, list(rows)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_on_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, tables(spark, str(tmp_path / "t"), []))
    assert out.count() == 0 and {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)


def test_pipeline_on_nulls_repeats_and_long_texts(spark, tmp_path):
    rows = [*corpus(), (40, words(30_000, 50)), (41, "x" * 40_000), (42, "mail " + "u@v.org " * 3_000)]
    out = corpus_pipeline.run(spark, tables(spark, str(tmp_path / "t"), rows, items=[(1, None), (2, ""), (None, "a b"), (3, words(30, 4))])).collect()
    ids = {r.doc_id for r in out}
    assert {3, 40, 41, 42, None} <= ids and 2 not in ids  # 2 holds item 3
    assert 8 not in ids and 9 not in ids  # copies of 7
    assert all(r.decoded == (r.text or "") for r in out)


CLASH = ["1 as n_links", "2 as class_id", "3 as rep", "4 as b", "5 as bucket", "6 as home", "7 as chunk", "8 as part", "9 as kind", "'x' as spans", "10 as id", "11 as pos", "12 as score", "13 as keep"]
OPERATORS = {
    "katz": (katz.score, ("doc_id", "n_tokens", "n_known")),
    "leaks": (lambda d: decontam.leaks(d, d.sparkSession.createDataFrame([(1, words(30, 4))], ITEMS)), ("doc_id", "item_id")),
    "pii": (pii.find, ("doc_id", "n_email", "base_sha256")),
    "ids": (lambda d: repair.report(repair.write(d)), ("doc_id", "start", "ids_crc32")),
    "classes": (nearjoin.classes, ("doc_id", "class_id", "n_links")),
    "quality": (lambda d: quality.score(d, quality.fit(d, d.sparkSession.createDataFrame([], LABELS))), ("doc_id", "keep")),
    "substring": (substring.dedup, ("doc_id", "n_words", "n_removed")),
    "pieces": (lambda d: pieces.decode(pieces.encode(d)), ("doc_id", "n_pieces", "decoded")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_extra_columns_of_clashing_names_and_empty_tables(spark, name):
    run, columns = OPERATORS[name]
    docs = docs_of(spark, corpus()[:12])
    plain, more = run(docs), run(docs.selectExpr("*", *CLASH))
    assert row_set(more.select(*columns), *columns) == row_set(plain.select(*columns), *columns)
    assert run(docs.limit(0)).count() == 0
