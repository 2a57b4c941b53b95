"""Cases in which an operator once did less than its whole job."""

import random
import re
import time

import numpy as np
import pytest

from splitline.llm import decontam, nearjoin, pii, quality

from .helpers import corpus, docs_of, row_set, words
from .test_search_and_joins import brute_classes


def test_copied_phrases_and_addresses_leave_a_pattern_confident(spark):
    rows = [(i, f"some words contact id u{i}@site{i}.example and more") for i in range(100)] + [(200, "some words contact id agent-77x today")]
    phrase = (300, "contact id " * 5_000)
    address = (301, "contact id u1@site1.example then " * 5_000)
    for extra in (phrase, address):
        got = {r.doc_id: r.spans for r in pii.find(docs_of(spark, [*rows, extra])).where("doc_id = 200").collect()}
        assert got == {200: "email:22:31"}
    common = [(400 + i, f"contact id word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyzuvwstqr'[i % 10]}") for i in range(130)]  # 130 other followers: no pattern
    assert [r.spans for r in pii.find(docs_of(spark, rows + common)).where("doc_id = 200").collect()] == [""]


def test_found_identifiers_bring_new_patterns(spark):
    rows = [(i, f"please reach me via u{i}@site{i}.example soon") for i in range(20)]
    rows += [(100 + i, f"please reach me via agent-7x{i} soon") for i in range(6)]
    rows += [(200 + i, f"your badge no agent-7x{i} expires") for i in range(6)]
    rows += [(300, "your badge no zz-99k expires"), (301, "some other zz-98k expires")]
    got = {r.doc_id: r.spans for r in pii.find(docs_of(spark, rows)).collect()}
    assert got[100] == "email:20:29" and got[200] == "email:14:23"
    assert got[300] == "email:14:20" and got[301] == ""


@pytest.mark.parametrize("end", ["How many apples does Tom have?", "How many apples are left in the basket?"])
def test_leaks_whose_sentences_start_with_the_replaced_name(spark, end):
    item = "Tom has 3 apples. Tom buys 4 more. " + end
    bench = spark.createDataFrame([(1, item), (2, "Maria walks to the mill with 5 sacks")], "item_id long, text string")
    texts = {
        1: item, 2: item.replace("Tom", "Anna"), 3: "as told before. " + item.replace("Tom", "Anna Maria") + " and so on", 4: item.replace("Tom", "Anna").replace(". How", "; how"),
        5: "Anna has 3 apples. Berta buys 4 more. " + end.replace("Tom", "Carla"), 6: "we saw Pedro walks to the mill with 9 sacks", 7: "The boy walks to the hill with 5 sacks",
    }
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.leaks(docs_of(spark, list(texts.items())), bench).collect()}
    # one name of the item became several in text 5
    assert got == {(1, 1): False, (2, 1): True, (3, 1): True, (4, 1): True, (6, 2): True}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.001"])
def test_quality_learns_from_few_ratings(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 5 <> 0"))
    assert (model.weights != 0).any()
    rated = quality.score(docs, model).join(quality.grades_of(labels.where("doc_id % 5 = 0")), "doc_id").collect()
    assert np.mean([r.keep == (r.grade == 2) for r in rated]) >= 0.9


def test_repeated_ids_are_one_document_with_the_first_text(spark):
    base = words(300, 40)
    rows = [*corpus(), (20, base), (20, base), (21, base + " end"), (22, base + " other"), (22, "a " + base), (23, words(50, 41)), (23, base)]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))  # the brute force takes the first row of an id
    got = row_set(nearjoin.classes(docs_of(spark, rows)), "doc_id", "class_id", "n_links")
    assert got == brute_classes(rows)


def test_exact_copies_of_number_dense_items_are_caught(spark):
    bench = spark.createDataFrame([(1, "Add 12 34 56 78"), (2, "7 8 9 10 11 12 13 14 15 16 17"), (3, "What is 3 times the number of apples in the basket?")], "item_id long, text string")
    texts = {1: "so Add 12 34 56 78 now", 2: "so Add 12 34 56 79 now", 3: "see 7 8 9 10 11 12 13 14 15 16 17 there", 4: "What is 5 times the number of apples in the basket?", 5: "1 2 3 4 5 6 7 8 9 10 20 30"}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs_of(spark, list(texts.items())), bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 3)}


def test_long_texts_and_words_are_scanned_in_linear_time():
    for piece in ("u1@site.example x77777 ", "u1@site.example,", "4111 1111 1111 1111 a1234 "):
        text = "w" * 100_000 + " " + piece * 20_000
        began = time.perf_counter()
        found = pii.mentions_of(text, pii.base_spans(text))
        keys = pii.contexts(text, found)
        assert len(keys) == len(found) and time.perf_counter() - began < 6


def test_contexts_are_whole_words():
    long = "x" * 300
    text = f"two {long} u1@site.example and id:u2@site.example,tel:u3@site.example"
    found = pii.base_spans(text)
    got = pii.contexts(text, found)
    assert got[0] == [pii._key("l1", pii._name(long)), pii._key("l2", "two", pii._name(long))]
    assert got[1] == [pii._key("l1", "id:"), pii._key("l2", "and", "id:")]
    assert got[2] == [pii._key("l1", ",tel:"), pii._key("l2", "and", ",tel:")]


def brute_mentions(text, spans):
    out = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        core = m.group().strip(pii.STRIP)
        s = m.start() + m.group().find(core)
        if re.search("[0-9@]", m.group()) and len(core) >= 5 and not any(x < s + len(core) and s < y for _, x, y in spans):
            out.append((None, s, s + len(core)))
    return spans + out


def test_mentions_against_every_pair():
    r = random.Random(4)
    for _ in range(3_000):
        text = "".join(r.choice("ab1@.-+ 0 ") for _ in range(r.randrange(80)))
        spans = pii.base_spans(text)
        assert pii.mentions_of(text, spans) == brute_mentions(text, spans)


def test_redaction_keeps_columns_whatever_their_names(spark):
    docs = docs_of(spark, [(1, "mail u1@site.example now"), (2, None)]).selectExpr("*", "'k' as _text_key", "1 as _more", "2 as key", "3 as row", "4 as id", "5 as _doc", "6 as _key")
    got = pii.redact(docs).orderBy("doc_id").collect()
    assert got[0].asDict() == {"doc_id": 1, "text": "mail <email> now", "lang": "en", "source": "s", "n_chars": 24, "_text_key": "k", "_more": 1, "key": 2, "row": 3, "id": 4, "_doc": 5, "_key": 6}
    assert got[1].text is None and pii.redact(docs).columns == docs.columns
