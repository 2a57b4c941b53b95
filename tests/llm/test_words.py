"""Katz scores and substring dedup against plain Python on whole small corpora."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from splitline.llm import chunks, katz, substring

from .helpers import corpus, docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_katz(rows, order=3):
    """The model as its docstring defines it, on dictionaries."""
    toks = [(i, [w.translate(UPPER) for w in WORD.findall(t or "")] + [None]) for i, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in toks]

    def context(ws, t, k):
        return tuple((["<s>"] * (k - 1) + ws)[t : t + k - 1])

    grams = {k: Counter() for k in range(1, order + 1)}
    for (_, ws), h in zip(toks, held):
        if not h:
            for k, c in grams.items():
                c.update((context(ws, t, k), w) for t, w in enumerate(ws))

    def discounts(counter):
        n = Counter(counter.values())
        b = 6 * n[6] / n[1] if n[1] else 1.0
        out = {}
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - b) / (1 - b) if n[r] and b < 1 else 0
            out[r] = d if 0 < d < 1 else 1 - 0.5 / r
        return lambda c: out.get(c, 1.0)

    one = Counter({w: c for (_, w), c in grams[1].items()})
    total, d = sum(one.values()), {k: discounts(c) for k, c in grams.items()}
    unknown = 1 - sum(d[1](c) * c for c in one.values()) / total if total else 1.0
    scale = 1.0
    if total and unknown < 1e-12:
        scale, unknown = total / (total + 1), 1 / (total + 1)
    after = {k: defaultdict(dict) for k in grams}
    for k, counter in grams.items():
        for (ctx, w), c in counter.items():
            after[k][ctx][w] = c
    memo = {}

    def p(ctx, w):
        k = len(ctx) + 1
        if k == 1:
            return scale * d[1](one[w]) * one[w] / total if one[w] else unknown
        seen = after[k].get(ctx)
        if not seen:
            return p(ctx[1:], w)
        if ctx not in memo:
            whole, kept = sum(seen.values()), sum(d[k](c) * c for c in seen.values())
            whole += all(c > 5 for c in seen.values())
            memo[ctx] = whole, (1 - kept / whole) / (1 - sum(p(ctx[1:], x) for x in seen))
        whole, alpha = memo[ctx]
        return d[k](seen[w]) * seen[w] / whole if w in seen else alpha * p(ctx[1:], w)

    base = lambda w: math.log10((one[w] + 0.1) / (total + 0.1 * (len(one) + 1)))
    out = [
        (i, h, len(ws), sum(one[w] > 0 for w in ws), total, sum(map(base, ws)), sum(math.log10(p(context(ws, t, order), w)) for t, w in enumerate(ws)))
        for (i, ws), h in zip(toks, held)
    ]
    return out, (p, one, after, unknown)


def brute_dedup(rows, n=20):
    ws = [(i if i is not None else -(1 << 63), WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in ws:
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (i, _), (k, w) in zip(rows, ws):
        gone = set()
        for s in range(len(w) - n + 1):
            f = first[tuple(w[s : s + n])]
            if f[0] < k or (f[0] == k and f[1] < s):
                gone.update(range(s, s + n))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, round(x, 4) if isinstance(x, float) else x) for x in r)


def same_scores(found, wanted):
    assert len(found) == len(wanted)
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


SCORE = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def scores(df):
    return [tuple(r[c] for c in SCORE) for r in df.collect()]


def removed(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=key)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_against_brute_force(spark, order):
    rows = corpus()
    same_scores(scores(katz.score(docs_of(spark, rows).repartition(3), order)), brute_katz(rows, order)[0])


def test_katz_on_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    same_scores(scores(katz.score(docs)), brute_katz(rows)[0])


def test_katz_sums_to_one():
    _, (p, one, after, unknown) = brute_katz(corpus()[:8])
    assert sum(p((), w) for w in one) + unknown == pytest.approx(1)
    for k in (2, 3):
        for ctx in list(after[k])[:150]:
            assert sum(p(ctx, w) for w in one) + p(ctx, "a word never seen") == pytest.approx(1)


def test_counts_pass_32_bits():
    v = np.array([0, 1, 2**32 + 5, 2**40, 2**62], dtype=np.int64)
    assert chunks.unpack_counts(chunks.pack_counts(v)).tolist() == v.tolist()
    assert katz._sums(np.array([0, 1, 0, 0]), [v[2:4], v[2:4]], 2).tolist() == [2 * (2**32 + 5) + 2**40, 2**40]
    with pytest.raises(OverflowError):
        chunks.pack_small(v)
    m = np.array([[2**33, 0], [0, 0], [0, 0], [0, 0], [0, 0], [2**45, 7], [0.25, 0.5]])
    want = [[2**45 + 2**33, 7], [0, 1], [2**33, 0], [0, 0], [0, 0], [0, 0], [0, 0], [0.25, 0.5]]
    assert katz._unpack_masses(katz._pack_masses(m, np.ones(2, bool))).tolist() == want
    one = np.array([True, False])
    assert katz._unpack_masses(katz._pack_masses(m, one), one).tolist() == [*want[:7], [0.25, 0]]


def test_katz_frequent_contexts_and_many_partitions(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(katz, "text_volume", lambda docs: 200_000_000)  # more ranges than words
    monkeypatch.setattr(katz, "MOST_FREQUENT", 40_000_000)
    monkeypatch.setattr(katz, "max", lambda *x: 5 if x[0] == 1_000 else max(*x), raising=False)
    same_scores(scores(katz.score(docs_of(spark, rows).repartition(5))), brute_katz(rows)[0])


def test_katz_empty_table_and_no_training(spark):
    assert katz.score(docs_of(spark, [])).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = katz.score(docs_of(spark, [(held, "a b")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) == (True, 3, 0, 0, 0.0)


def test_substring_against_brute_force(spark):
    rows = corpus()
    assert removed(substring.dedup(docs_of(spark, rows).repartition(4))) == sorted(brute_dedup(rows), key=key)


def test_substring_on_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert removed(substring.dedup(docs)) == sorted(brute_dedup(rows), key=key)


def test_substring_ranges_and_a_sketch_too_small(spark, monkeypatch):
    rows = corpus()

    class Small(substring.Plan):
        def __init__(self, volume, window, depth):
            super().__init__(volume, window, depth)
            self.bits, self.cut = 9, 3  # collisions everywhere: the exact pass decides

    monkeypatch.setattr(substring, "Plan", Small)
    assert removed(substring.dedup(docs_of(spark, rows).repartition(6))) == sorted(brute_dedup(rows), key=key)


def test_substring_empty_and_extra_columns(spark):
    assert substring.dedup(docs_of(spark, [])).count() == 0
    docs = docs_of(spark, corpus())
    more = docs.selectExpr("*", "1 as n_words", "2 as chunk", "3 as home", "4 as part", "'x' as body")
    assert removed(substring.dedup(more)) == removed(substring.dedup(docs))


def test_chunk_round_trip():
    ids, texts = [1, None, 3], [[b"a", b"b", b"a"], [], [b"c"]]
    c = chunks._make(5, ids, texts)
    back = chunks.Chunk.load(5, c.dump())
    assert back.doc_ids.tolist() == [1, chunks.NO_ID, 3] and back.lens.tolist() == [3, 0, 1]
    assert [back.words[i] for i in back.tokens.tolist()] == [b"a", b"b", b"a", b"c"]
