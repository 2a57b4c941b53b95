"""Chunks: the documents of one scan task in runs of about a million words, dictionary-coded.

A chunk is named by its scan task and its place there; up to 2**HOME_BITS
neighbours share a home, by which the chunks' table is bucketed, so that answers
travel to the chunks and the texts stay where they were written. Packed
columns are zstd frames of byte planes; high planes of small numbers vanish.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize_by, planes, text_bytes, unplanes

NO_ID = -(1 << 63)
HOME_BITS = 2
#: Spark's own bound of a table's buckets.
MOST_BUCKETS = 100_000


_SQUEEZER, _LOOSENER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(blob: bytes) -> bytes:
    return _SQUEEZER.compress(blob)


def loosen(blob: bytes) -> bytes:
    return _LOOSENER.decompress(blob)


def _low_planes(v: np.ndarray) -> bytes:
    """64-bit values as the byte planes that hold anything, lowest first, after the number of planes."""
    k = max(1, -(-int(v.max()).bit_length() // 8)) if len(v) else 1
    return bytes([k]) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    k = raw[0]
    p = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(k, -1)
    out = np.zeros((p.shape[1], 8), dtype=np.uint8)
    out[:, :k] = p.T
    return out.view(np.uint64).ravel()


def pack_sorted(v: np.ndarray) -> bytes:
    """Ascending values as the planes of their differences."""
    return squeeze(_low_planes(np.diff(np.ascontiguousarray(v, dtype=np.uint64), prepend=np.uint64(0))))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(loosen(blob)), dtype=np.uint64)


def pack_small(v: np.ndarray) -> bytes:
    return squeeze(planes(v))


def unpack_small(blob: bytes) -> np.ndarray:
    return unplanes(loosen(blob))


def pack_counts(v: np.ndarray) -> bytes:
    """64-bit values from 0 in their given order."""
    return squeeze(_low_planes(np.ascontiguousarray(v, dtype=np.int64).view(np.uint64)))


def unpack_counts(blob: bytes) -> np.ndarray:
    return _from_planes(loosen(blob)).view(np.int64)


def pack_bits(v: np.ndarray) -> bytes:
    return squeeze(len(v).to_bytes(8, "little") + np.packbits(v).tobytes())


def unpack_bits(blob: bytes) -> np.ndarray:
    raw = loosen(blob)
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(bool)


@dataclass
class Chunk:
    name: int
    doc_ids: np.ndarray  # int64, NO_ID for null
    lens: np.ndarray  # int64 words of each document
    words: list[bytes]  # distinct words, frequent ones first
    tokens: np.ndarray  # int64 places in ``words``

    def dump(self) -> bytes:
        parts = [self.doc_ids.astype("<i8").tobytes(), planes(self.lens), b" ".join(self.words), planes(self.tokens)]
        return squeeze(b"".join(len(p).to_bytes(8, "little") + p for p in parts))

    @classmethod
    def load(cls, name: int, blob: bytes) -> Chunk:
        raw, at, parts = loosen(blob), 0, []
        while at < len(raw):
            n = int.from_bytes(raw[at : at + 8], "little")
            parts.append(raw[at + 8 : at + 8 + n])
            at += 8 + n
        return cls(name, np.frombuffer(parts[0], "<i8"), unplanes(parts[1]).astype(np.int64), parts[2].split(b" ") if parts[2] else [], unplanes(parts[3]).astype(np.int64))

    def take(self, docs: np.ndarray) -> Chunk:
        """The chunk of the documents at ``docs`` (a mask)."""
        tokens = self.tokens[np.repeat(docs, self.lens)]
        used, codes = np.unique(tokens, return_inverse=True)
        return Chunk(self.name, self.doc_ids[docs], self.lens[docs], [self.words[i] for i in used.tolist()], codes)


def _make(name: int, ids: list, texts: list[list[bytes]]) -> Chunk:
    known: dict[bytes, int] = {}
    add = known.setdefault
    tokens = np.array([add(w, len(known)) for words in texts for w in words], dtype=np.int64)
    words = list(known)
    if words:
        order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        words, tokens = [words[i] for i in order.tolist()], place[tokens]
    return Chunk(name, np.array([NO_ID if i is None else i for i in ids], dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64), words, tokens)


def chunked(batches, limit: int = 1_000_000, lower: bool = False):
    """Chunks of (doc_id, text) batches, cut before ``limit`` words are passed; a longer document is one chunk."""
    ids: list = []
    texts: list[list[bytes]] = []
    size = number = 0
    task = TaskContext.get().partitionId() << 32
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
            words = (text.lower() if lower else text).split()
            if ids and size + len(words) > limit:
                yield _make(task | number, ids, texts)
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(doc)
            texts.append(words)
            size += len(words)
    if ids:
        yield _make(task | number, ids, texts)


def scan_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def home(chunk: str = "chunk") -> Column:
    return F.shiftright(chunk, HOME_BITS)


def encoded(docs: DataFrame, volume: int, lower: bool = False) -> DataFrame:
    """(home long, chunk long, body binary) of all documents, written once: every later pass reads the same chunks. ``volume``: see :func:`text_volume`."""

    def run(batches):
        for c in chunked(batches, lower=lower):
            yield pa.RecordBatch.from_arrays([pa.array([c.name >> HOME_BITS], pa.int64()), pa.array([c.name], pa.int64()), pa.array([c.dump()], pa.binary())], names=["home", "chunk", "body"])

    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(least, volume // 4_000_000))
    return materialize_by(scan_of(docs).mapInArrow(run, "home long, chunk long, body binary"), "chunks", "home", buckets)


def with_answers(chunks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """``run(chunk, its rows of answers)`` for every chunk; only ``answers`` (with a column chunk) are shuffled."""

    def each(bodies: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        own = dict(list(got.groupby("chunk")))
        return pd.concat([run(Chunk.load(name, body), own.get(name, got.iloc[:0])) for name, body in zip(bodies["chunk"].tolist(), bodies["body"])] or [pd.DataFrame(columns=names)])

    names = [x.split()[0] for x in schema.split(", ")]
    return chunks.groupBy("home").cogroup(answers.withColumn("home", home()).groupBy("home")).applyInPandas(each, schema)


def loaded(batches):
    """The chunks of (chunk, body) batches."""
    for b in batches:
        for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield Chunk.load(name, body)


def text_volume(docs: DataFrame) -> int:
    """An upper bound of the words in all texts, from one narrow scan."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 + 1
