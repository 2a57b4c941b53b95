"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (toxic), 1 (poor) or 2 (good). One latent score, the sum
of shared weights over the document's hashed text features, is cut by ordered
thresholds: P(grade <= j) = sigmoid(t_j - score). Expected grade and the tail
probability P(grade >= 2) follow; selection keeps documents whose tail
probability reaches ``keep_tail``.

Features are hashed presences: each distinct word core (lower case, outer
punctuation stripped), the 4- and 5-character pieces of the cores with their
word boundaries, and, for four shape shares (symbol endings, bars, upper case,
immediate repeats), the tenth its share of all words falls in. Whole texts are
read at fit and at scoring. Only features whose association with the grade is
significant (chi-square p-values on the rated documents at a false-discovery
rate of ``fdr``, by Benjamini and Hochberg's rule) carry weight, so that long
ordinary texts don't drift; the bound follows the number of rated documents.

Defined cases: a null or empty text has shape features only (all shares 0); null
ratings count as 0; several ratings of one document count as the worst; ratings
without a document and documents without a rating are fine; repeated rows score
alike; with no rated document every row gets NaN-free neutral values and is
kept. Extra columns are ignored by :func:`score` and kept by :func:`select_good`.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, text_bytes

BITS = 20
MASK = (1 << BITS) - 1
STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN_END = frozenset(b".,;:'\")?")
SCHEMA = "score double, expected_grade double, tail_prob double, keep boolean"


def _shape(word: bytes) -> tuple[tuple[int, ...], bool, bool, bool]:
    """(buckets of the core and its character pieces, symbol ending, bar, upper case)."""
    bare = word.strip(STRIP)
    text = bare.decode("utf-8", "replace")
    core = "^" + text.lower() + "$"
    last = word[-1]
    symbol = last < 128 and not (48 <= last <= 57 or 65 <= last <= 90 or 97 <= last <= 122) and last not in PLAIN_END and word != b"|"
    found = {core} | {core[i : i + n] for n in (4, 5) for i in range(len(core) - n + 1)} if bare else set()
    return tuple({zlib.crc32(x.encode()) & MASK for x in found}), symbol, word == b"|", len(text) > 1 and text.isupper()


#: Ends of words that count as symbols.
SYMBOL = bytes(c < 128 and not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) and c not in PLAIN_END for c in range(256))


def _crc_tables(n: int) -> tuple[int, list[np.ndarray]]:
    """crc32 of ``n`` bytes as a constant and a table a position, to be combined by exclusive or: the checksum is linear in the bits."""
    zero = zlib.crc32(bytes(n))
    return zero, [np.array([zlib.crc32(bytes(j) + bytes([c]) + bytes(n - j - 1)) ^ zero for c in range(256)], dtype=np.uint32) for j in range(n)]


CRC = {n: _crc_tables(n) for n in (4, 5)}


def piece_buckets(cores: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the core, bucket) of each of the cores and of their pieces of 4 and 5 characters. Cores are ASCII."""
    size = np.array([len(c) for c in cores])
    blob = np.frombuffer(b"".join(cores), dtype=np.uint8)
    owner = np.repeat(np.arange(len(cores)), size)
    room = np.cumsum(size)[owner] - np.arange(len(blob))  # bytes of its core from each place on
    owners, buckets = [np.arange(len(cores))], [np.array([zlib.crc32(c) for c in cores], dtype=np.uint32)]
    for n, (zero, tables) in CRC.items():
        at = np.flatnonzero(room >= n)
        crc = np.full(len(at), zero, dtype=np.uint32)
        for j, t in enumerate(tables):
            crc ^= t[blob[at + j]]
        owners.append(owner[at])
        buckets.append(crc)
    return np.concatenate(owners), np.concatenate(buckets) & MASK


class Shapes(dict):
    """Shapes of the words met of late, of two generations of ``limit`` words at most; with ``used``, only buckets where it holds a 1. A word
    without any has None."""

    def __init__(self, used: bytes | None = None, limit: int = 100_000):
        super().__init__()
        self.used, self.limit, self.old = None if used is None else np.frombuffer(used, dtype=bool), limit, {}

    def learn(self, words) -> None:
        """Add the shapes of ``words``; those of ASCII words are hashed together."""
        cores, named = [], []
        for w in words:
            got = self.old.get(w, 0)
            if got == 0:
                bare = w.strip(STRIP)
                if self.used is None or not bare.isascii():
                    got = _shape(w)
                    if self.used is not None:
                        got = (tuple(b for b in got[0] if self.used[b]), *got[1:])
                else:
                    got = ((), bool(SYMBOL[w[-1]]) and w != b"|", w == b"|", len(bare) > 1 and bare.isupper())
                    if bare:
                        cores.append(b"^" + bare.lower() + b"$")
                        named.append(w)
            self[w] = got if got and any(got) else None
        if cores:
            owners, buckets = piece_buckets(cores)
            hit = self.used[buckets]
            for i, b in zip(owners[hit].tolist(), buckets[hit].tolist()):
                got = self[named[i]] or ((), False, False, False)
                self[named[i]] = ((*got[0], b), *got[1:])

    def turn(self) -> None:
        """Between texts: a full generation becomes the old one."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


def features(text: bytes, known: Shapes) -> list[int]:
    """Distinct hashed features of one whole text."""
    words = text.split()
    known.turn()
    counts = Counter(words)
    fresh = [w for w in counts if w not in known]
    if fresh:
        known.learn(fresh)
    buckets: set[int] = set()
    symbol = bar = upper = 0
    for w, got in zip(counts, map(known.__getitem__, counts)):
        if got:
            buckets.update(got[0])
            n = counts[w]
            symbol += n * got[1]
            bar += n * got[2]
            upper += n * got[3]
    repeat = sum(map(bytes.__eq__, words, words[1:]))
    n = max(1, len(words))
    for kind, share in enumerate((symbol, bar, upper, repeat)):
        buckets.add(zlib.crc32(b"~shape%d:%d" % (kind, -(-10 * share // n))) & MASK)
    return list(buckets)


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, one per hash bucket: 4 MB, a fixed size
    thresholds: tuple[float, float]
    trained: bool

    def predict(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= 2)."""
        if not self.trained:
            return np.full(len(score), 1.0), np.full(len(score), 1.0)
        ge1 = 1 / (1 + np.exp(np.clip(self.thresholds[0] - score, -500, 500)))
        ge2 = 1 / (1 + np.exp(np.clip(self.thresholds[1] - score, -500, 500)))
        return ge1 + ge2, ge2


def screen(by_grade: np.ndarray, present: np.ndarray, min_df: int = 2, fdr: float = 0.001) -> np.ndarray:
    """Features whose association with the grade is significant at the false-discovery rate. ``by_grade``: documents by (grade, feature)."""
    n = present.sum()
    df = by_grade.sum(0)
    chi = np.zeros(1 << BITS)
    for top, share_low in enumerate(np.cumsum(present)[:2] / max(1, n)):
        hit = by_grade[: top + 1].sum(0)
        spread = df * share_low * (1 - share_low) * (1 - df / max(1, n))
        chi = np.maximum(chi, np.where(spread > 0, (hit - df * share_low) ** 2 / np.maximum(spread, 1e-9), 0))
    seen = np.flatnonzero(df >= min_df)
    p = np.array([min(1.0, 2 * math.erfc(math.sqrt(x / 2))) for x in chi[seen].tolist()])  # the better of two cuts
    order = np.argsort(p, kind="stable")
    passed = np.flatnonzero(p[order] <= fdr * np.arange(1, len(seen) + 1) / max(1, len(seen)))
    return np.sort(seen[order[: passed[-1] + 1]]) if len(passed) else seen[:0]


def fit_arrays(docs: list[np.ndarray], grades: np.ndarray, used: np.ndarray, rounds: int = 150, l2: float = 1.0) -> OrdinalModel:
    """Full-batch AdaGrad on the ordinal log likelihood over the features ``used``; all others keep weight 0."""
    weights = np.zeros(1 << BITS, dtype=np.float32)
    present = np.bincount(grades, minlength=3) if len(grades) else np.zeros(3)
    if (present > 0).sum() < 2:
        return OrdinalModel(weights, (-1.0, 1.0), False)
    n = len(grades)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    kept = [p[p >= 0] for p in (place[f] for f in docs)]
    ids, rows, size = np.concatenate(kept), np.repeat(np.arange(n), [len(k) for k in kept]), len(used)
    w = np.zeros(size)
    share = (np.cumsum(present)[:2] + 0.5) / (present.sum() + 1.5)
    t = np.log(share / (1 - share))
    history, t_history = np.full(size, 1e-8), np.full(2, 1e-8)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for _ in range(rounds):
        s = np.bincount(rows, w[ids], minlength=n)
        low, high = sigmoid(t[0] - s), sigmoid(t[1] - s)
        p = np.select([grades == 0, grades == 1], [low, high - low], 1 - high).clip(1e-9)
        d_low, d_high = low * (1 - low), high * (1 - high)
        # derivatives of log p by t_0 and t_1; the score enters with the opposite sign
        g0 = np.where(grades == 0, d_low, np.where(grades == 1, -d_low, 0)) / p
        g1 = np.where(grades == 1, d_high, np.where(grades == 2, -d_high, 0)) / p
        g = -np.bincount(ids, (g0 + g1)[rows], minlength=size) - l2 * w
        gt = np.array([g0.sum(), g1.sum()])
        history += g * g
        t_history += gt * gt
        w += 0.3 * g / np.sqrt(history)
        t = t + 0.3 * gt / np.sqrt(t_history)
        t[1] = max(t[1], t[0] + 1e-3)
    weights[used] = w
    return OrdinalModel(weights, (float(t[0]), float(t[1])), True)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the worst rating of each document."""
    return (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("_t"), F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("_q"))
        .select("doc_id", F.when(F.col("_t") >= 1, 0).when(F.col("_q") >= 1, 2).otherwise(1).cast("int").alias("grade"))
    )


def fit(docs: DataFrame, labels: DataFrame, max_rated: int = 6_000) -> OrdinalModel:
    """Fit on at most ``max_rated`` rated documents, those with the smallest hash of their id: the documented bound of the sample."""
    sample = grades_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)

    def featurize(batches):
        known = Shapes()
        for b in batches:
            found = [np.sort(np.array(features(x, known), dtype=np.uint32)).tobytes() for x in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(found, pa.binary())], names=["grade", "f"])

    rated = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # the sample has max_rated rows at most
    found = materialize(rated.select("grade", "text").mapInArrow(featurize, "grade int, f binary").distinct(), "rated")  # copies count once
    present, by_grade = np.zeros(3, dtype=np.int64), np.zeros((3, 1 << BITS), dtype=np.int32)
    for r in found.groupBy("grade").count().collect():
        present[r["grade"]] = r["count"]

    def count(batches):  # documents by grade and feature, added up before they are sent
        sums = np.zeros((3, 1 << BITS), dtype=np.int32)
        for b in batches:
            for grade, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[grade, np.frombuffer(f, dtype=np.uint32)] += 1
        grade, feature = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(grade.astype(np.int32)), pa.array(feature), pa.array(sums[grade, feature].astype(np.int64))], names=["grade", "feature", "n"])

    counts = found.mapInArrow(count, "grade int, feature long, n long").groupBy("grade", "feature").agg(F.sum("n").alias("n")).toArrow()  # 3 * 2**BITS rows at most
    by_grade[counts["grade"].to_numpy(), counts["feature"].to_numpy()] = counts["n"].to_numpy()
    used = screen(by_grade, present)
    mask = docs.sparkSession.sparkContext.broadcast(np.packbits(np.isin(np.arange(1 << BITS), used)).tobytes())

    def keep(batches):
        bits = np.unpackbits(np.frombuffer(mask.value, dtype=np.uint8)).view(bool)
        for b in batches:
            kept = [f[bits[f]].tobytes() for f in (np.frombuffer(x, dtype=np.uint32) for x in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], names=["grade", "f"])

    rows = sorted((bytes(r.f), r.grade) for r in found.mapInArrow(keep, "grade int, f binary").collect())  # max_rated rows of screened features
    return fit_arrays([np.frombuffer(f, dtype=np.uint32) for f, _ in rows], np.array([g for _, g in rows], dtype=np.int64), used)


def _scorer(spark, model: OrdinalModel, keep_tail: float):
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        w, known = m.weights.astype(np.float64), Shapes((m.weights != 0).tobytes())
        for b in batches:
            s = np.array([w[features(x, known)].sum() for x in text_bytes(b.column("text"))], dtype=np.float64)
            grade, tail = m.predict(s)
            own = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array(grade), pa.array(tail), pa.array(tail >= keep_tail)], names=[*b.schema.names, "score", "expected_grade", "tail_prob", "keep"])

    return run


def score(docs: DataFrame, model: OrdinalModel, keep_tail: float = 0.5) -> DataFrame:
    """doc_id, score, expected_grade, tail_prob, keep for every row."""
    rows = docs.select("doc_id", "text").mapInArrow(_scorer(docs.sparkSession, model, keep_tail), f"doc_id long, text string, {SCHEMA}")
    return rows.drop("text")


def select_good(docs: DataFrame, model: OrdinalModel, keep_tail: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    columns = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_{i}" if c != "text" else "text") for i, c in enumerate(columns)])
    fields = ", ".join(f"`{n}` {t}" for n, t in inner.dtypes)
    kept = inner.mapInArrow(_scorer(docs.sparkSession, model, keep_tail), f"{fields}, {SCHEMA}").where("keep")
    return kept.select(*[F.col(f"_{i}" if c != "text" else "text").alias(c) for i, c in enumerate(columns)])
