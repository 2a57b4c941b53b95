"""Phrase collocation mining per language.

Texts are lower-cased (A-Z only) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces,
those at spaces and tabs into words. Everything is counted per ``lang``.

1. Every word and every run of up to ``max_n`` words inside a piece becomes a row
   (language, phrase, count), combined per chunk of some million words in NumPy
   first; Spark hash-aggregates the rows per (language, phrase). Words and pairs
   are counted from one reading. A run of three words or more is made only where
   both its one word shorter parts may reach ``floor`` (a bitmap of their hashes,
   which has no false negatives and is sized from their number, at most
   2**``MOST_BITS`` bits): a phrase is never commoner than its parts, so no other
   can be a candidate, extend one or be a part of one. That takes one more reading
   per length and keeps most of the rows, those of rare runs, out of the shuffle.
   Rows under ``floor`` are then folded into one per language, which keeps the
   number of all words.
2. Candidates are the phrases of 2 words and more. Each cut after k words joins
   the counts of its two parts, l and r; the score floor(10**6 * a * a / (l * r))
   is computed in Decimal. The lowest cut counts, ties to the smallest k.
3. A candidate goes when a longer one that holds its words has at least
   ``inside`` percent of its occurrences. One-word extensions decide that: a
   phrase between the two is at least as common as the longer one. They are
   reduced to the commonest per phrase and anti-joined.
4. The first ``top`` of each language by score, count and phrase: ranked within
   ``SALTS`` slices of a language first, so that no task sorts a whole language.

A language may hold most rows: the counts are keyed by phrase as well, so that a
hot phrase is one row a chunk, and totals are sums. A word that begins or ends very many
candidates makes a skewed join side, which Spark's adaptive execution splits.

Defined cases: a null text is empty; a null language is ``und``, together with
rows that say so; an empty language is a language; repeated rows count each time;
very long texts and words are whole; doc_id and extra columns are not read; an
empty table, and one without candidates, give no rows; counts whose product
passes 38 digits are an error.
"""

from __future__ import annotations

import math
import re
import string
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bitmap
from .common import materialize, mix, text_bytes

SALTS = 64
#: Words that are counted together before their rows are sent, and bytes of text that are cut into words at a time.
CHUNK, SLICE = 2_500_000, 4_000_000
LEAST_BITS, MOST_BITS = 16, 27
#: Ends of pieces become a byte that no UTF-8 text holds.
_END = b"\xff"
_BREAKS = bytes(c if chr(c) not in ".,;:!?\n\v\f\r" else 255 for c in range(256))
_GAP = re.compile(rb"[\x20\x09\xff]")


class _Words:
    """Texts of one language as codes of their words, 0 at the ends of pieces."""

    def __init__(self):
        self.code = defaultdict(None, {_END: 0})
        self.code.default_factory = self.code.__len__
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        """Slices are cut at a gap, so that words and the runs over a cut stay whole."""
        text, at = text.lower().translate(_BREAKS), 0  # bytes.lower() knows A-Z only
        while at < len(text):
            gap = _GAP.search(text, at + SLICE) if at + SLICE < len(text) else None
            stop = gap.start() if gap else len(text)
            words = text[at:stop].replace(_END, b" \xff ").split()  # of bytes: at spaces and tabs, the breaks are gone
            self.runs.append(np.fromiter(map(self.code.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
            at = stop
        self.runs.append(np.zeros(1, np.int32))

    def parts(self) -> tuple[np.ndarray, pa.Array]:
        return np.concatenate(self.runs), pa.array(list(self.code), pa.binary())


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _keys(hashes: list[np.ndarray]) -> np.ndarray:
    """Keys of runs of words, from the hashes of their first, second, ... words."""
    total = np.zeros(len(hashes[0]), dtype=np.uint64)
    for j, h in enumerate(hashes):
        total += mix(h + np.uint64(j + 1))
    return mix(total)


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = _seed(lang)
    return np.array([xxhash.xxh3_64_intdigest(w, seed=seed) for w in words], dtype=np.uint64)


def _runs(codes: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of each distinct run of n words as rows, their counts)."""
    at = np.flatnonzero(codes[: len(codes) - n + 1] > 0) if len(codes) >= n else np.zeros(0, np.int64)
    for j in range(1, n):
        at = at[codes[at + j] > 0]
    return _distinct(codes, at, n, size)


def _distinct(codes: np.ndarray, at: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    key, heads = codes[at].astype(np.int64), []
    for j in range(1, n):  # runs of j words are numbered, so that a number and a word fit 64 bits
        if j > 1:
            head, key = np.unique(key, return_inverse=True)
            heads.append(head)
        key = key * size + codes[at + j]
    key, counts = np.unique(key, return_counts=True)
    columns = []
    while heads:
        columns.append(key % size)
        key = heads.pop()[key // size]
    columns += [key % size, key // size] if n > 1 else [key]
    return np.stack(columns[::-1], axis=1) if len(key) else np.zeros((0, n), np.int64), counts


def _phrases(rows: np.ndarray, words: pa.Array) -> pa.Array:
    parts = [words.take(pa.array(rows[:, j])) for j in range(rows.shape[1])]
    return (parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))).cast(pa.string())


def grams(docs: DataFrame, lengths: list[int], frequent: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, f): the runs of so many words of each chunk with their counts there. ``frequent``: a bitmap; only runs whose parts
    without their last and without their first word are in it."""
    sent = None if frequent is None else docs.sparkSession.sparkContext.broadcast(np.packbits(frequent).tobytes())
    bits = None if frequent is None else int(math.log2(len(frequent)))

    def counted(lang: str, texts: _Words):
        codes, words = texts.parts()
        size = len(words)
        for n in lengths:
            if sent is None:
                rows, counts = _runs(codes, n, size)
            else:
                known = np.frombuffer(sent.value, dtype=np.uint8)
                hashes = np.concatenate([np.zeros(1, np.uint64), _word_hashes(words.to_pylist()[1:], lang)])
                at = np.flatnonzero(codes[: max(0, len(codes) - n + 1)] > 0)
                for j in range(1, n):
                    at = at[codes[at + j] > 0]
                for start in (0, 1):
                    slot = (_keys([hashes[codes[at + start + j]] for j in range(n - 1)]) >> np.uint64(64 - bits)).astype(np.int64)
                    at = at[(known[slot >> 3] >> (7 - (slot & 7))) & 1 > 0]
                rows, counts = _distinct(codes, at, n, size)
            for i in range(0, len(rows), 100_000):
                part = _phrases(rows[i : i + 100_000], words)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(counts[i : i + 100_000].astype(np.int64))], names=["lang", "phrase", "f"])

    def run(batches):
        open_: dict[str, _Words] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                open_.setdefault(lang, _Words()).add(text)
                if sum(w.size for w in open_.values()) >= CHUNK:
                    for key, words in open_.items():
                        yield from counted(key, words)
                    open_ = {}
        for key, words in open_.items():
            yield from counted(key, words)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, phrase string, f long")


def _bitmap(known: DataFrame) -> np.ndarray:
    """A bitmap of the phrases' keys, of 16 bits a phrase while that is at most 2**MOST_BITS."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, known.count())))))

    def run(batches):
        for b in batches:
            keys = []
            for lang, phrase in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                keys.append(_keys([h[None] for h in _word_hashes(phrase.split(b" "), lang)])[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64))], names=["key"])

    return bitmap.build(known.select("lang", "phrase").mapInArrow(run, "key long"), "key", 64 - bits, bits)


def counts(docs: DataFrame, max_n: int, floor: int) -> list[DataFrame]:
    """(lang, phrase, f, words, size) by reading: phrases with f >= floor, and rows with a null phrase for all others; the first reading's words
    sum to the language's words."""

    def summed(rows: DataFrame) -> DataFrame:
        f = rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        single = F.when(F.instr("phrase", " ") == 0, F.col("f")).otherwise(0)
        return f.groupBy("lang", F.when(F.col("f") >= floor, F.col("phrase")).alias("phrase")).agg(F.max("f").alias("f"), F.sum(single).alias("words"))

    size = F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1
    levels = [materialize(summed(grams(docs, [n for n in (1, 2) if n <= max_n])).withColumn("size", size), "collocations")]
    for n in range(3, max_n + 1):
        parts = levels[-1].where(F.col("size") == n - 1)
        levels.append(materialize(summed(grams(docs, [n], _bitmap(parts))).withColumn("size", size), "collocations"))
    return levels


def _first_words(k: Column) -> Column:
    """The first k words of a phrase, or for k < 0 its last -k."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)


def scored(known: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, a, size) with l, r and score of their lowest cut."""
    cut = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    left = _first_words(F.col("k"))
    halves = cut.select("*", left.alias("left"), F.substr("phrase", F.length(left) + 2).alias("right"))
    of = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    both = halves.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = both.select("lang", "phrase", "a", "k", "l", "r", *[F.col(c).cast("decimal(19,0)").alias(f"_{c}") for c in "alr"])
    score = F.expr("(_a * _a * CAST(1000000 AS DECIMAL(7,0))) div (_l * _r)")  # of two Decimals: exact, and at most 10**6
    best = wide.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, max_n: int = 3, floor: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    levels = counts(docs, max_n, floor)
    totals = levels[0].groupBy("lang").agg(F.sum("words").alias("n"))
    known = reduce(DataFrame.unionByName, levels).where("phrase IS NOT NULL").select("lang", "phrase", "f", "size")
    candidates = known.where("size >= 2").withColumnRenamed("f", "a")
    less = F.array(_first_words(F.col("size") - 1), _first_words(1 - F.col("size")))
    longer = candidates.where("size >= 3").select("lang", F.explode(less).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(longer, (candidates["lang"] == longer["lang"]) & (candidates["phrase"] == longer["phrase"]) & (100 * longer["longer"] >= inside * candidates["a"]), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = scored(known, kept).withColumn("rank", F.row_number().over(slices)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)  # of at most SALTS * top rows a language
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_RUNS = "\n".join(f"UNION ALL SELECT lang, array_to_string(w[i:i + {k}], ' '), {k + 1} FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 1})) AS i FROM w)" for k in (1, 2))

ORACLE = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(w) AS phrase, 1 AS size FROM w
{_RUNS}),
t AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
x AS (
  SELECT c.lang, c.phrase, c.f AS a, k, a.f AS l, b.f AS r, (1000000 * CAST(c.f AS HUGEINT) * c.f) // (CAST(a.f AS HUGEINT) * b.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
  JOIN f a ON a.lang = c.lang AND a.phrase = array_to_string(string_split(c.phrase, ' ')[:k], ' ')
  JOIN f b ON b.lang = c.lang AND b.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT s.* FROM s WHERE NOT EXISTS (
    SELECT 1 FROM f q WHERE q.size = 3 AND q.lang = s.lang AND 100 * q.f >= 50 * s.a AND len(string_split(s.phrase, ' ')) = 2
      AND s.phrase IN (array_to_string(string_split(q.phrase, ' ')[:2], ' '), array_to_string(string_split(q.phrase, ' ')[2:], ' '))))
SELECT o.lang, CAST(row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM o JOIN t ON o.lang = t.lang
QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
