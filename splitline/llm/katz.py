"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

Tokens of a text: its words (ASCII lower-cased) and one end token. The model has
orders 1 to ``order`` (3 by default): P_k(w | ctx) with ctx the k - 1 tokens
before, begin tokens standing before a text.

* Counts come from the training documents only. ``d_r`` discounts a count r of at
  most 5 by Good-Turing, ``(r*/r - b) / (1 - b)`` with ``r* = (r+1) n_{r+1} / n_r``
  and ``b = 6 n_6 / n_1``, order by order; where that isn't in (0, 1) it is
  ``1 - 0.5 / r``.
* Order 1: P_1(w) = d c(w) / N; what is left goes to the one unknown word.
* Order k: P_k(w | ctx) = d c(ctx w) / (c(ctx) + e) where ctx w was seen, else
  alpha(ctx) P_{k-1}(w | ctx less its oldest token). e is 1 where every seen word
  of the context counts more than 5, so that nothing would be left for backing off,
  else 0. alpha(ctx) = (1 - sum of P_k over seen w) / (1 -
  sum of P_{k-1} over the same w), so that P_k(. | ctx) sums to 1 exactly over all
  words and the unknown one. A context never seen has alpha 1. Evaluation recurs
  from the highest order down to order 1.

The model's tables are partitioned by key: words by their hash, longer grams by
their context (those of a frequent context also by the word, so no context's grams
meet in one task), and nothing of them is gathered. A gram is a context and a word;
its number is the next order's context. A chunk of documents (:mod:`.chunks`) asks
the partitions of each order in turn for its distinct grams, once each, and gets
packed answers: counts, numbers, and the masses of their contexts; so a frequent
word or gram counts once per chunk however often it occurs. Counts are 64-bit.

Defined cases: a null or empty text is the end token alone; null doc_ids train
(their crc32 is that of the empty text) and are reported with doc_id null; with
no training token N is 0 and every score uses P1(unknown) = 1; repeated rows each
count and are scored; extra columns are ignored; whole texts are read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .chunks import NO_ID, Chunk, encoded, loaded, loosen, pack_bits, pack_counts, pack_sorted, squeeze, text_volume, unpack_bits, unpack_counts, unpack_sorted, with_answers
from .common import materialize, mix

#: A word that can't occur in a text (it holds white space): the end token; the begin token has number 0.
END = b" "
K = 5
ORDER = 3
#: At most so many contexts of an order count as frequent, whatever the input: their sums are shared with all tasks.
MOST_FREQUENT = 20_000
#: Words of input in a partition of an order's table.
PART_WORDS = 2_000_000


@dataclass(frozen=True)
class Discounts:
    """d_1 .. d_5 of one order, d_0 and those above are 1."""

    d: tuple[float, ...]

    @classmethod
    def of(cls, n: dict[int, int]) -> Discounts:
        b = (K + 1) * n.get(K + 1, 0) / n[1] if n.get(1) else 1.0
        out = []
        for r in range(1, K + 1):
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - b) / (1 - b) if n.get(r) and b < 1 else 0.0
            out.append(d if 0 < d < 1 else 1 - 0.5 / r)
        return cls((1.0, *out, 1.0))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.array(self.d)[np.minimum(counts, K + 1)]


@dataclass(frozen=True)
class Unigrams:
    """What all tasks need of order 1: a few numbers."""

    total: int  # N
    distinct: int  # V
    discounts: Discounts
    unknown: float

    def p(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.float64)
        return np.where(counts > 0, self.discounts(counts) * c / max(1, self.total), self.unknown)


def held_out(doc_ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == NO_ID else str(i).encode()) % 10 == 0 for i in doc_ids.tolist()], dtype=bool)


def _tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes ascending, their code per token with ends added, document of each token, training mask of documents)."""
    words = [*c.words, END]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    order = np.argsort(h)
    place = np.empty(len(h), dtype=np.int32)
    place[order] = np.arange(len(h), dtype=np.int32)
    n = len(c.tokens) + len(c.lens)
    codes = np.full(n, len(words) - 1, dtype=np.int32)
    ends = np.cumsum(c.lens + 1) - 1
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    codes[inside] = c.tokens
    return h[order], place[codes], np.repeat(np.arange(len(c.lens), dtype=np.int32), c.lens + 1), ~held_out(c.doc_ids)


def _slices(keys: np.ndarray, cut: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of ascending 64-bit keys by their top ``cut`` bits."""
    at = np.searchsorted(keys, np.arange(1 << cut, dtype=np.uint64) << np.uint64(64 - cut) if cut else np.zeros(1, np.uint64)).tolist() + [len(keys)]
    return [(k, i, j) for k, (i, j) in enumerate(zip(at, at[1:])) if i < j]


def word_requests(chunks: DataFrame, cut: int) -> DataFrame:
    """(part, chunk, keys, counts): each chunk's distinct words with their training counts."""

    def run(batches):
        for c in loaded(batches):
            h, codes, doc, train = _tokens(c)
            counts = np.bincount(codes[train[doc]], minlength=len(h))
            part, a, b = zip(*[(k, pack_sorted(h[i:j]), pack_counts(counts[i:j])) for k, i, j in _slices(h, cut)])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([c.name] * len(part), pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["part", "chunk", "keys", "counts"])

    return chunks.select("chunk", "body").mapInArrow(run, "part int, chunk long, keys binary, counts binary")


_MERGED = "kind int, chunk long, part int, a binary, b binary, r long, n long, m binary"
#: A gram's number is its partition above so many bits and its place there, from 1.
NUMBER_BITS = 32


@dataclass(frozen=True)
class Plan:
    """Sizes shared by all tasks: the highest order, bits of the partition, and the count from which a context is frequent."""

    order: int
    cut: int
    frequent: int


def _count_rows(part: int, values: np.ndarray) -> list[tuple]:
    """Counts of counts (1 .. 6), the distinct (r = -1) and the total (r = 0)."""
    seen = values[values > 0]
    rows = [(2, None, part, None, None, r, int((seen == r).sum())) for r in range(1, K + 2)]
    return [*rows, (2, None, part, None, None, -1, len(seen)), (2, None, part, None, None, 0, int(seen.sum()))]


def _merged_frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame([(*r, *[None] * (8 - len(r))) for r in rows], columns=[x.split()[0] for x in _MERGED.split(", ")])
    for name, kind in (("kind", "Int32"), ("chunk", "Int64"), ("part", "Int32"), ("r", "Int64"), ("n", "Int64")):
        df[name] = df[name].astype(kind)
    return df


def _counts_of_counts(merged: DataFrame) -> dict[int, int]:
    return {r.r: int(r.n) for r in merged.where("kind = 2").groupBy("r").agg(F.sum("n").alias("n")).collect()}


def _split(values: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(lengths)[:-1])


def merge_words(requests: DataFrame, frequent: int) -> DataFrame:
    """Kind 1: each chunk's answers (training count and place of every word it asked for). Kind 2: counts of counts. Kind 3: numbers (n) of the frequent words."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(x) for x in rows["keys"]]
        part, lengths = int(rows["part"].iloc[0]), [len(k) for k in keys]
        values, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = _sums(at, [unpack_counts(x) for x in rows["counts"]], len(values))
        out = [(1, c, part, pack_counts(counts[a]), pack_sorted(a), None, None) for c, a in zip(rows["chunk"].tolist(), _split(at, lengths))]
        return _merged_frame(out + _count_rows(part, counts) + _frequent_rows(part, counts, frequent))

    return requests.groupBy("part").applyInPandas(run, _MERGED)


def _sums(at: np.ndarray, counts: list[np.ndarray], size: int) -> np.ndarray:
    """Exact 64-bit sums by place."""
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, at, np.concatenate(counts))
    return out


def _frequent_rows(part: int, counts: np.ndarray, frequent: int) -> list[tuple]:
    return [(3, None, part, None, None, None, (part << NUMBER_BITS) + int(i) + 1) for i in np.flatnonzero(counts >= frequent)]


@dataclass
class Level:
    """A chunk's distinct grams of one order: number (0 is the begin context's), training count, and the gram of each token."""

    number: np.ndarray  # uint64
    count: np.ndarray  # int64
    at: np.ndarray  # int64, one per token


def _numbers(part: int, places: np.ndarray) -> np.ndarray:
    return np.uint64(part << NUMBER_BITS) + places.astype(np.uint64) + np.uint64(1)


def _answers_of(got: pd.DataFrame, order: int) -> dict[int, tuple]:
    own = got[got["order"] == order]
    return {p: (a, b, m) for p, a, b, m in zip(own["part"].tolist(), own["a"], own["b"], own["m"])}


def _words_level(h: np.ndarray, codes: np.ndarray, got: pd.DataFrame, cut: int) -> Level:
    counts, number = np.zeros(len(h), np.int64), np.zeros(len(h), np.uint64)
    have = _answers_of(got, 1)
    for k, i, j in _slices(h, cut):
        a, b, _ = have[k]
        counts[i:j], number[i:j] = unpack_counts(a), _numbers(k, unpack_sorted(b))
    return Level(number, counts, codes)


@dataclass
class Grams:
    """A chunk's distinct grams of the next order by (part, context, word)."""

    slices: list[tuple[int, int, int]]  # (part, from, to)
    context: np.ndarray
    word: np.ndarray | None
    lower: np.ndarray | None  # training count of the gram less its oldest token
    at: np.ndarray  # int32, one per token


def _ranked(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each, numbers ascending)."""
    order = np.argsort(numbers)
    rank = np.empty(len(numbers), dtype=np.int64)
    rank[order] = np.arange(len(numbers))
    return rank, numbers[order]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values ascending, place of each value): one sort of value and position together where both fit 63 bits."""
    n = len(key)
    bits = max(1, (n - 1).bit_length())
    if not n or int(key.max()).bit_length() + bits > 63:
        return np.unique(key, return_inverse=True)
    both = np.sort((key << bits) | np.arange(n))
    value = both >> bits
    head = _heads(value)
    place = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    place[both & ((1 << bits) - 1)] = np.cumsum(head) - 1
    return value[head], place


def _grams(below: Level, words: Level, doc: np.ndarray, frequent: int, cut: int) -> Grams:
    n = len(doc)
    rank, contexts = _ranked(below.number)
    word_rank, word_numbers = _ranked(words.number)
    code = np.zeros(n, dtype=np.int64)  # the begin context
    same = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    code[same] = rank[below.at[same - 1]] + 1
    distinct, at = _distinct(code * np.int64(len(word_rank)) + word_rank[words.at])
    code, w = np.divmod(distinct, np.int64(max(1, len(word_rank))))
    context = np.concatenate([np.zeros(1, np.uint64), contexts])[code]
    ordered = np.empty(len(rank), dtype=np.int64)
    ordered[rank] = below.count
    count = np.concatenate([np.full(1, frequent, np.int64), ordered])[code]
    word = word_numbers[w]
    lower = np.empty(len(distinct), dtype=np.int64)
    lower[at] = below.count[below.at]
    spread = mix(np.where(count >= frequent, mix(context) + word, context))  # a frequent context's grams are dealt by the word too
    part = (spread >> np.uint64(64 - cut) if cut else np.zeros(len(word), np.uint64)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if cut <= 16 else part, kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return Grams(_part_slices(part[order]), context[order], word[order], lower[order], place[at])


def _part_slices(part: np.ndarray) -> list[tuple[int, int, int]]:
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return [(int(part[i]), int(i), int(j)) for i, j in zip(heads, np.append(heads[1:], len(part)))]


def _heads(context: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], context[1:] != context[:-1]])


def _climb(c: Chunk, got: pd.DataFrame, plan: Plan, upto: int):
    """The chunk's levels 1 .. upto, and the grams of orders 2 .. upto + 1 (those of the last are not answered yet)."""
    h, codes, doc, train = _tokens(c)
    levels, grams = [_words_level(h, codes, got, plan.cut)], []
    for order in range(2, upto + 2):
        if order > plan.order:
            break
        g = _grams(levels[-1], levels[0], doc, plan.frequent, plan.cut)
        grams.append(g)
        if order > upto:
            break
        have = _answers_of(got, order)
        g.word = g.lower = None  # only requests need them
        count, number = np.zeros(len(g.context), np.int64), np.zeros(len(g.context), np.uint64)
        for k, i, j in g.slices:
            count[i:j], number[i:j] = unpack_counts(have[k][0]), _numbers(k, unpack_sorted(have[k][1]))
        levels.append(Level(number, count, g.at))
    return levels, grams, doc, train


def gram_requests(chunks: DataFrame, answers: DataFrame, plan: Plan, order: int) -> DataFrame:
    """(part, chunk, contexts, words, counts, lowers): each chunk's distinct grams of ``order``, their training counts and those of their lower grams."""

    def run(c: Chunk, got: pd.DataFrame) -> pd.DataFrame:
        _, grams, doc, train = _climb(c, got, plan, order - 1)
        g = grams[-1]
        n = np.bincount(g.at[train[doc]], minlength=len(g.context))
        rows = [(k, c.name, pack_sorted(g.context[i:j]), pack_counts(g.word[i:j].view(np.int64)), pack_counts(n[i:j]), pack_counts(g.lower[i:j])) for k, i, j in g.slices]
        return pd.DataFrame(rows, columns=["part", "chunk", "contexts", "words", "counts", "lowers"])

    return with_answers(chunks, answers, run, "part int, chunk long, contexts binary, words binary, counts binary, lowers binary")


def _masses(context: np.ndarray, size: int, n: np.ndarray, lower: np.ndarray, below: Discounts) -> np.ndarray:
    """Per context: summed counts by count class (1 .. 5, above), and the discounted lower counts of the seen words."""
    level = np.minimum(n, K + 1)
    rows = [np.bincount(context, np.where(level == r, n, 0), minlength=size) for r in range(1, K + 2)]
    return np.stack([*rows, np.bincount(context, np.where(n > 0, below(lower) * lower, 0.0), minlength=size)])


def merge_grams(requests: DataFrame, below: Discounts, contexts: np.ndarray, frequent: int, last: bool) -> DataFrame:
    """Kind 1: each chunk's answers: count and place of each gram, masses of each context. Kind 2: counts of counts. Kind 3: numbers
    of the frequent grams. Kind 4: masses of the frequent contexts here. ``contexts``: numbers of the frequent contexts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        own = [unpack_sorted(x) for x in rows["contexts"]]
        lengths = [len(x) for x in own]
        known, v = np.unique(np.concatenate(own), return_inverse=True)
        words, w = np.unique(np.concatenate([unpack_counts(x) for x in rows["words"]]).view(np.uint64), return_inverse=True)
        distinct, at = _distinct(v * np.int64(len(words)) + w)
        del w
        context = distinct // np.int64(len(words))
        n = _sums(at, [unpack_counts(x) for x in rows["counts"]], len(distinct))
        lower = np.empty(len(distinct), dtype=np.int64)
        lower[at] = np.concatenate([unpack_counts(x) for x in rows["lowers"]])
        mass = _masses(context, len(known), n, lower, below)
        out = []
        for c, mine, a, x in zip(rows["chunk"].tolist(), own, _split(at, lengths), _split(v, lengths)):
            head = _heads(mine)
            count = n[a]
            missing = np.add.reduceat(count == 0, np.flatnonzero(head)) > 0  # only these contexts are backed off from here
            m = mass[:, x[head]]
            out.append((1, c, part, pack_counts(count), None if last else pack_sorted(a), None, None, _pack_masses(m, missing)))
        hot = np.isin(known, contexts)
        out.append((4, None, part, pack_sorted(known[hot]), None, None, None, _pack_masses(mass[:, hot], np.ones(int(hot.sum()), bool))))
        return _merged_frame(out + _count_rows(part, n) + ([] if last else _frequent_rows(part, n, frequent)))

    return requests.groupBy("part").applyInPandas(run, _MERGED)


def _pack_masses(m: np.ndarray, some: np.ndarray) -> bytes:
    """Totals of all contexts and whether nothing is discounted there; counts of the discounted classes and lower sums of ``some`` of them only."""
    counts = m[: K + 1].astype(np.int64)
    parts = [pack_counts(counts.sum(0)), pack_bits(~counts[:K].any(0)), pack_counts(counts[:K, some].ravel()), squeeze(np.ascontiguousarray(m[K + 1][some]).tobytes())]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _unpack_masses(blob: bytes, some: np.ndarray | None = None) -> np.ndarray:
    """Rows per context: total, 1 where nothing is discounted, counts of the discounted classes, lower sum. ``some``: None if all were packed."""
    at, parts = 0, []
    for _ in range(4):
        n = int.from_bytes(blob[at : at + 8], "little")
        parts.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    total = unpack_counts(parts[0])
    out = np.zeros((K + 3, len(total)))
    some = slice(None) if some is None else some
    out[0], out[1] = total, unpack_bits(parts[1])
    out[2 : K + 2, some] = unpack_counts(parts[2]).reshape(K, -1)
    out[K + 2, some] = np.frombuffer(loosen(parts[3]), dtype=np.float64)
    return out


def frequent_masses(merged: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(contexts ascending, masses) of the frequent contexts over all partitions: at most MOST_FREQUENT + 1 of them."""
    names = ["context", *(f"m{i}" for i in range(K + 3))]

    def run(batches):
        for b in batches:
            for a, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(unpack_sorted(a).astype(np.int64)), *map(pa.array, _unpack_masses(m))], names=names)

    rows = merged.where("kind = 4").select("a", "m").mapInArrow(run, ", ".join(f"{x} {'long' if x == 'context' else 'double'}" for x in names))
    got = rows.groupBy("context").agg(*[F.sum(x).alias(x) for x in names[1:]]).orderBy("context").collect()
    mass = np.array([r[1:] for r in got], dtype=np.float64).reshape(len(got), K + 3).T
    mass[1] = ~mass[2 : K + 2].any(0)
    return np.array([r[0] for r in got], dtype=np.uint64), mass


@dataclass(frozen=True)
class Order:
    """What all tasks need of an order above 1 besides its partitioned table."""

    discounts: Discounts
    contexts: np.ndarray
    masses: np.ndarray

    def weights(self, g: Grams, have: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per gram: its count, and of its context c + e, what is left for backing off, and the seen words' lower sum."""
        size = len(g.context)
        n, whole, left, lower = np.zeros(size, np.int64), np.ones(size), np.ones(size), np.zeros(size)
        for k, i, j in g.slices:
            a, _, masses = have[k]
            n[i:j] = unpack_counts(a)
            head = _heads(g.context[i:j])
            m = _unpack_masses(masses, np.add.reduceat(n[i:j] == 0, np.flatnonzero(head)) > 0)
            if len(self.contexts):
                own = g.context[i:j][head]
                spot = np.minimum(np.searchsorted(self.contexts, own), len(self.contexts) - 1)
                hot = self.contexts[spot] == own
                m[:, hot] = self.masses[:, spot[hot]]
            seen = m[0] > 0
            bottom = np.where(seen, m[0] + m[1], 1.0)
            rest = m[1] + ((1 - np.array(self.discounts.d)[1 : K + 1, None]) * m[2 : K + 2]).sum(0)
            context = np.cumsum(head) - 1
            whole[i:j] = bottom[context]
            left[i:j] = np.where(seen, rest / bottom, 1.0)[context]
            lower[i:j] = np.where(seen, m[K + 2], 0.0)[context]
        return n, whole, left, lower


def score_chunks(chunks: DataFrame, answers: DataFrame, uni: Unigrams, orders: list[Order], plan: Plan) -> DataFrame:
    """One row per document. ``answers``: (chunk, order, part, a, b, m)."""

    def run(c: Chunk, got: pd.DataFrame) -> pd.DataFrame:
        levels, grams, doc, train = _climb(c, got, plan, plan.order - 1)
        counts = levels[0].count[levels[0].at]
        del levels
        p, below = uni.p(counts), np.full(len(doc), float(max(1, uni.total)))
        for order, model in enumerate(orders, 2):
            g = grams.pop(0)
            n, whole, left, lower = model.weights(g, _answers_of(got, order))
            seen = np.where(n > 0, model.discounts(n) * n / whole, 0.0)[g.at]  # a seen gram's probability is above 0
            p = np.where(seen > 0, seen, left[g.at] / (1 - lower[g.at] / below) * p)
            below = whole[g.at]
        base = np.log10((counts + 0.1) / (uni.total + 0.1 * (uni.distinct + 1)))
        size = len(c.lens)
        add = lambda x: np.bincount(doc, x, minlength=size)
        return pd.DataFrame(
            {"doc_id": pd.array([None if i == NO_ID else i for i in c.doc_ids.tolist()], dtype="Int64"), "held_out": ~train, "n_tokens": c.lens + 1, "n_known": add(counts > 0).astype(np.int64),
             "train_tokens": uni.total, "base_score": add(base), "score": add(np.log10(p))}
        )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers(chunks, answers, run, out)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; the model is trained on those not held out."""
    volume = text_volume(docs)
    cut = max(0, min(24, math.ceil(math.log2(volume / PART_WORDS)) if volume > PART_WORDS else 0))
    plan = Plan(order, cut, max(1_000, volume // MOST_FREQUENT))
    chunks = encoded(docs, volume, lower=True)
    words = materialize(merge_words(word_requests(chunks, cut), plan.frequent), "katz-1")
    n = _counts_of_counts(words)
    discounts = Discounts.of(n)
    seen = sum(discounts.d[r] * r * n.get(r, 0) for r in range(1, K + 1)) + n.get(0, 0) - sum(r * n.get(r, 0) for r in range(1, K + 1))
    total = n.get(0, 0)
    unknown = 1 - seen / total if total else 1.0
    if total and unknown < 1e-12:  # every word is frequent: one more unit of count for the unknown word
        discounts, unknown = Discounts((1.0, *(d * total / (total + 1) for d in discounts.d[1:-1]), total / (total + 1))), 1 / (total + 1)
    uni = Unigrams(total, n.get(-1, 0), discounts, unknown)
    told = lambda merged, k: merged.where("kind = 1").select("chunk", F.lit(k).alias("order"), "part", "a", "b", "m")
    answers, orders, merged = told(words, 1), [], words
    for k in range(2, order + 1):
        frequent = np.array([0, *sorted(r.n for r in merged.where("kind = 3").select("n").collect())], dtype=np.uint64)  # the begin context is one
        merged = materialize(merge_grams(gram_requests(chunks, answers, plan, k), discounts, frequent, plan.frequent, k == order), f"katz-{k}")
        discounts = Discounts.of(_counts_of_counts(merged))
        orders.append(Order(discounts, *frequent_masses(merged)))
        answers = answers.unionByName(told(merged, k))
    return score_chunks(chunks, answers, uni, orders, plan)
