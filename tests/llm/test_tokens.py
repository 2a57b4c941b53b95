"""Token blocks and pieces: exact round trips and the tokenizers library itself."""

import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece  # noqa: F401
from tokenizers import Tokenizer

from splitline.llm import pieces, repair

from .helpers import corpus, docs_of

ODD = ["", " ", None, "Don't STOP,now!!! it's 12.5% (really)...", "ÀÉÎ Straße, İstanbul ΣΑΣ ΟΔΟΣ. naïve,", "日本語 テスト。 한국어", "a b c ́x é", "<|endoftext|> x<|startoftext|>", "😀😀 tail$$$ $$$ 'tis 's", "x" * 5000, "▁ literal ▁mark", "two  spaces   three", " lead and trail "]


def test_ids_against_the_tokenizers_library(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + k, t) for k, (_, t) in enumerate(corpus())]
    tok = Tokenizer.from_file(repair.default_path())
    want, start = {}, 0
    for i, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = repair.report(repair.write(docs_of(spark, rows).repartition(3), block_ids=2_000)).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


#: Letters whose normal form ends in a combining mark: Turkish, Bengali, Hindi, Hebrew.
MARKED = ["VALİ.", "BELEDİYESİ,", "İİ!!", "হয়.", "लड़,", "שּׁ!", "x לּ."]


def library(path, texts):
    tok = Tokenizer.from_file(path)
    return [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_ids_of_random_unicode_against_the_library():
    r = random.Random(1)
    pool = [c for c in map(chr, range(0x20, 0x20000)) if unicodedata.category(c) not in ("Cs", "Cn")]
    some = "abcXYZ .,!?'-<>|\t\n 09"
    texts = MARKED + ["".join(r.choice(pool) if r.random() < 0.4 else r.choice(some) for _ in range(r.randrange(1, 14))) for _ in range(5_000)]
    texts += [f"ab{c}. {c}!! {c}'s" for c in pool if c.isalpha()][::3]
    assert [x.tolist() for x in repair.encoder(repair.default_path())(pa.array(texts))] == library(repair.default_path(), texts)


def test_another_vocabulary_is_encoded_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*MARKED, "two  spaces\n and Tail,  ", None, ""]
    encode = repair.Encoder(path)
    assert not encode.by_words and [x.tolist() for x in encode(pa.array(texts))] == library(path, [t or "" for t in texts])
    got = repair.report(repair.write(docs_of(spark, list(enumerate(texts))), path)).orderBy("start").collect()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in library(path, [t or "" for t in texts])]


def test_one_doc_id_is_split_over_shards(spark, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_BYTES", 2_000)
    rows = [(7, f"text {i} of many") for i in range(500)] + [(None, "same text") for _ in range(300)] + [(9, "x " * 9_000)]
    blocks = repair.write(docs_of(spark, rows))
    assert blocks.where("n_ids > 0").select("shard").distinct().count() > 3
    got = repair.report(blocks).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 300 + [7] * 500 + [9]
    starts = np.cumsum([0] + [r.n_tokens for r in got])[:-1]
    assert [r.start for r in got] == starts.tolist()


def test_ids_of_nulls_repeats_and_an_empty_table(spark):
    rows = [(None, "x y"), (None, "b"), (3, "same"), (3, "same"), (2, "first")]
    got = repair.report(repair.write(docs_of(spark, rows))).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 2, 3, 3]
    assert repair.report(repair.write(docs_of(spark, []))).count() == 0


def test_one_document_of_a_block_decodes_alone(spark):
    rows = [(i, f"word {i % 3} of many words " * 20) for i in range(30)]
    tok = Tokenizer.from_file(repair.default_path())
    for block in repair.write(docs_of(spark, rows)).collect():
        names = np.frombuffer(block["doc_ids"], "<i8")
        assert len(block["rules"]) > 0
        for k, name in enumerate(names.tolist()):
            assert repair.decode_document(block, k).tolist() == [*tok.encode(rows[name][1], add_special_tokens=False).ids, 1]


def test_repair_restores_random_ids():
    r = np.random.default_rng(3)
    for vocabulary, n in ((3, 4_000), (50, 20_000), (70_000, 500), (1, 999)):
        ids = r.integers(0, vocabulary, n).astype(np.uint32)
        ends = r.random(n) < 0.02
        ends[-1] = True
        seq, last, rules = repair.compress(ids, ends, vocabulary)
        assert repair.expand(seq, rules, repair.expansion_lengths(rules, vocabulary), vocabulary).tolist() == ids.tolist()
        assert last.sum() == ends.sum()


def test_pieces_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + corpus()
    got = pieces.decode(pieces.encode(docs_of(spark, rows))).collect()
    assert len(got) == len(rows)
    assert all(r.decoded == (r.text or "") and r.n_pieces == len(r.piece_ids) for r in got)


def test_literal_markers_split_a_text_exactly():
    """Word by word, and between literal markers, the search gives what one search of the whole text gives."""
    model = pieces.model_at(pieces.default_path())
    r = random.Random(8)
    texts = ["▁", "a▁", "▁a b▁▁c", "  ▁ x"] + ["".join(r.choice(["▁", " ", "the", "ab", "é", "日", "q"]) for _ in range(12)) for _ in range(300)]
    for t in texts:
        b = t.encode()
        marks, at = set(), 3
        for c in t:
            if c == "▁":
                marks.add(at)
            at += 3 if c == " " else len(c.encode())
        whole = model.viterbi(pieces.MARK_B + b.replace(b" ", pieces.MARK_B), frozenset(marks))
        got = np.frombuffer(model.encode(b), "<i4").tolist()
        score = lambda ids: sum(model.unknown / 3 if i in model.byte_ids else model.scores[i] for i in ids)
        assert got == whole or abs(score(got) - score(whole)) < 1e-9  # equal scores may split differently
        assert model.decode(got) == b


def test_pieces_keep_columns_and_an_empty_table(spark):
    docs = docs_of(spark, [(1, "a b"), (None, None)]).selectExpr("*", "1 as _e", "2 as row", "3 as found", "'x' as n_pieces")
    got = pieces.decode(pieces.encode(docs))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_e", "row", "found", "piece_ids", "n_pieces", "ids_crc32", "decoded"]
    assert [(r._e, r.row, r.found, r.decoded) for r in got.orderBy("doc_id").collect()] == [(1, 2, 3, ""), (1, 2, 3, "a b")]
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0
    long = docs_of(spark, [(1, "word " * 50_000), (2, "日本" * 20_000), (3, "x" * 60_000), (4, " " * 20_000 + "▁" * 5_000)])
    assert all(r.decoded == r.text for r in pieces.decode(pieces.encode(long)).collect())


def test_viterbi_is_the_best_segmentation():
    model = pieces.model_at(pieces.default_path())

    def brute(s: bytes) -> float:
        best = [0.0] + [-1e18] * len(s)
        table = {model.bytes_of[i].replace(b" ", pieces.MARK_B): model.scores[i] for i in model.normal}
        for i in range(len(s)):
            width = 1 if s[i] < 0x80 else 2 if s[i] < 0xE0 else 3 if s[i] < 0xF0 else 4
            if i and s[i] & 0xC0 == 0x80:
                continue
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in table:
                    best[j] = max(best[j], best[i] + table[s[i:j]])
            if s[i : i + width] not in table:
                best[i + width] = max(best[i + width], best[i] + model.unknown)
        return best[-1]

    for word in ["hello", "segmentation", "zzqqx", "naïveté", "ab日c"]:
        s = pieces.MARK_B + word.encode()
        ids = model.viterbi(s)
        pending = [i for i in ids if i not in model.byte_ids]
        unknown = [c for c in word if model.trie and c.encode() not in {model.bytes_of[i] for i in model.normal}]
        assert sum(model.scores[i] for i in pending) + len(unknown) * model.unknown == __import__("pytest").approx(brute(s))
        assert np.frombuffer(model.viterbi_batch([s])[0], "<i4").tolist() == ids
