"""KD-tree search, Jaccard classes, decontamination, PII, quality, revisits and the pipeline on small fixtures."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from splitline.llm import decontam, graph, kdtree, nearjoin, pieces, pii, quality, warc

from .helpers import corpus, docs_of, row_set, words


def brute_top(rows, k=5):
    ok = [(i, v) for i, v in rows if i is not None and v is not None]
    out = []
    for n, (q, x) in enumerate(ok):
        if q % 5 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, v)), i) for m, (i, v) in enumerate(ok) if m != n and len(v) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [7, 10_000])
def test_kdtree_against_brute_force(spark, shard_rows):
    r = random.Random(5)
    rows = [(i, [r.randrange(-3, 4) for _ in range(4)]) for i in range(120)] + [(500, None), (None, [1, 1, 1, 1]), (505, [1, 2]), (600, []), (601, [])]
    rows += [(700 + i, [2, 2, 2, 2]) for i in range(60)] + [(5, [1, 0, 1, 0]), (5, [1, 0, 1, 0]), (900, [2**30, 1, 0, 0]), (901, [2**30, 2, 0, 0])]  # equal vectors, shared ids, large numbers
    v = spark.createDataFrame(rows, "id long, v array<long>").selectExpr("*", "1 as row", "2 as leaf")
    got = kdtree.top_k(v, F.col("id") % 5 == 0, shard_rows=shard_rows, batch=8)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_queries_reach_only_shards_that_can_beat_the_kth(spark, monkeypatch):
    r = random.Random(6)
    rows = []
    for i in range(2_000):  # eight clusters at the corners of a cube
        rows.append((i, [r.randrange(0, 3) + (100 if i % 8 >> axis & 1 else -100) for axis in range(3)]))
    seen = {}
    monkeypatch.setattr(kdtree, "reach", lambda q, boxes, own=kdtree.reach: seen.setdefault("reach", own(q, boxes)))
    got = kdtree.top_k(spark.createDataFrame(rows, "id long, v array<long>"), F.col("id") % 5 == 0, shard_rows=100)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert seen["reach"].count() < 0.3 * 400 * 20  # of 400 queries by 20 shards and more


def test_quantize_and_empty_vectors(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, None), (4, [float("inf"), 0.0]), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, e array<float>").select("id", kdtree.quantize("e").alias("v"))
    assert {r.id: r.v for r in df.collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None}
    assert kdtree.top_k(df.where("id > 9"), F.lit(True)).count() == 0


def brute_classes(rows, threshold=0.8):
    sets = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])} for i in sets}
    out = []
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        out.append((i, min(seen), len(links[i])))
    return sorted(out)


@pytest.mark.parametrize("block", [3, 64])
def test_classes_against_brute_force(spark, block):
    base = words(300, 40).split()
    rows = [x for x in corpus() if x[0] not in (None, 16)]
    for k in range(40):  # a group of near copies, some of them exact
        w = list(base)
        for p in range(k % 7):
            w[37 * p] = f"new{k}"
        rows.append((100 + k, " ".join(w)))
    got = row_set(nearjoin.classes(docs_of(spark, rows), block=block), "doc_id", "class_id", "n_links")
    assert got == brute_classes(rows)
    kept = nearjoin.deduplicate(docs_of(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_classes(rows)})
    assert kept.columns == docs_of(spark, []).columns


def test_classes_on_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert row_set(nearjoin.classes(docs), "doc_id", "class_id", "n_links") == brute_classes(rows)


def test_components_of_a_chain_and_of_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(chain, "src long, dst long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert nearjoin.classes(docs_of(spark, [])).count() == 0


QUESTION = "A farmer sells 12 apples to Maria for 3 dollars each and then buys 5 sacks of seed for the field behind the old mill near the river"


def test_decontamination_catches_reparameterised_questions(spark):
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, ""), (4, words(40, 77)), (1, QUESTION)], "item_id long, text string")
    other = QUESTION.replace("12", "40").replace("Maria", "Pedro").replace(" 3 ", " 9 ")
    docs = docs_of(spark, [(1, words(50, 1) + ". " + QUESTION + ". " + words(50, 2)), (2, words(30, 3) + ". " + other), (3, words(80, 4)), (4, None), (5, ""), (None, QUESTION)])
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 1): False, (2, 1): True}
    kept = decontam.decontaminate(docs, bench)
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect() if r.doc_id) == [(True, 3), (True, 4), (True, 5)]
    assert kept.columns == docs.columns
    assert decontam.leaks(docs, bench.where("item_id > 9")).count() == 0


def plain_spans(text):
    """The base patterns as the contract words them, with plain regular expressions."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m.group())) <= 15]


def test_base_spans_against_plain_patterns(spark, sf):
    r = random.Random(9)
    texts = ["".join(r.choice("ab.@-+ 0123456789()%_\n") for _ in range(r.randrange(60))) for _ in range(4_000)]
    texts += [x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "1" * 5_000, "a@b.c" * 400]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t)


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"some words contact id u{i}@site{i}.example and more") for i in range(20)] + [(50, "some words contact id agent-77x today"), (51, None), (52, ""), (None, "x@y.org")]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert got[50].startswith("email:22:") and got[51] == got[52] == "" and got[None] == "email:0:7"
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[50] == "some words contact id <email> today" and clean[51] is None and clean[3] == "some words contact id <email> and more"
    assert pii.find(docs_of(spark, [])).count() == 0


def test_quality_on_held_out_ratings(spark):
    """813 held-out ratings of sf0.1; those of sf0.01 and sf0.001 are in test_whole_jobs."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 5 <> 0"))
    rated = quality.score(docs, model).join(quality.grades_of(labels.where("doc_id % 5 = 0")), "doc_id").collect()
    assert np.mean([r.keep == (r.grade == 2) for r in rated]) > 0.95
    assert np.mean([r.keep for r in rated if r.grade == 2]) > 0.99  # clean documents stay
    assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 for r in rated)


def test_quality_defined_cases(spark):
    docs = docs_of(spark, corpus()).selectExpr("*", "1 as score", "true as keep")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.select_good(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0


def test_revisits_against_plain_python(spark):
    r = random.Random(2)
    urls = ["http://www.a.org/x", "https://a.org/x/", "http://b.org/y?utm_source=q", "b.org/y#z", "HTTPS://user:pw@A.org:443/x", None]
    rows = [(i, r.choice(urls), r.choice([None, *range(60)]), r.choice(["response", "revisit"]), r.choice([None, "e1", "e2"]), r.choice([None, "m1"]), r.choice([None, "d1", "d2"]), {"Date": str(i), "X": "1"}) for i in range(300)]
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    site = lambda u: None if u is None else "a.org/x" if "a.org" in u.lower() else "b.org/y"
    for bucket in (20, 100_000):
        got = {x.record_id: x for x in warc.resolve_revisits(records, bucket).collect()}
        assert sorted(got) == sorted(x[0] for x in rows if x[1] and x[2] is not None and x[3] == "revisit")
        for i, x in got.items():
            before = [y for y in rows if site(y[1]) == site(rows[i][1]) and y[2] is not None and y[3] == "response" and y[2] < rows[i][2]]
            best = max(before, key=lambda y: (y[2], y[0]), default=None)
            assert x.canonical_url == site(rows[i][1]) and x.response_id == (best[0] if best else None)
            if x.status in ("resolved", "unverified"):
                assert x.headers == {"Date": str(i), "X": "1"}
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_canonical_urls(spark):
    same = ["http://a.org/p?b=2&a=1", "https://www.a.org:443/p/?a=1&utm_source=x&b=2", "a.org:80/p.html?a=1&b=2#top", "http://me@a.org/p?b=2&&a=1"]
    other = ["http://a.org:8080/p?a=1&b=2", "http://a.org/p?a=%2f", "http://a.org/p?a=%2F", "http://a.org/p%", None]
    got = [r.c for r in spark.createDataFrame([(u,) for u in same + other], "u string").select(warc.canonical_url(F.col("u")).alias("c")).collect()]
    assert set(got[:4]) == {"a.org/p?a=1&b=2"} and got[4:] == ["a.org:8080/p?a=1&b=2", "a.org/p?a=%2F", "a.org/p?a=%2F", "a.org/p%", None]


def test_revisit_report_of_an_empty_table(spark):
    assert warc.revisit_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages_agree_with_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "lang", "source", "n_chars", "piece_ids", "decoded"} <= set(out.columns)
    good = quality.select_good(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    one = {c for _, c, _ in brute_classes([(r.doc_id, r.text) for r in good.collect()])}
    leaked = {r.doc_id for r in decontam.leaks(docs, bench).collect()}
    rows = out.collect()
    assert {r.doc_id for r in rows} == one - leaked
    assert all(r.decoded == (r.text or "") and not pii.base_spans(r.text or "") for r in rows)
    assert pieces.decode(pieces.encode(docs)).count() == docs.count()


def test_a_sample_takes_few_rows_of_each_partition(spark):
    rows = spark.range(200_000, numPartitions=64).select(F.col("id").alias("row"))
    low = kdtree._low(rows, 200_000, 1000)
    assert 1000 <= low.count() <= 2000  # before, 1,000 of each of 64 partitions came to the driver
    least = lambda df: [x.row for x in df.orderBy(F.xxhash64("row")).limit(1000).collect()]
    assert least(low) == least(rows)
    assert kdtree._low(rows.limit(900), 900, 1000).count() == 900


def test_queries_are_not_sent_to_all_tasks(spark):
    schema = "dim long, leaf long, sub long, tree binary"
    asked = spark.createDataFrame([(1, 1, [1], None, 1, 0, 0)], "row long, id long, v array<long>, kth struct<score:long,vec_id:long,vec_row:long>, dim long, leaf long, sub long")
    plan = kdtree._searched(spark.createDataFrame([(1, 0, 0, b"")], schema), asked, 5, 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1  # the row a shard
