"""Substring dedup: repeated 20-word windows by a count-min prefilter and exact grouping.

A window is ``window`` consecutive words of one document. A word is removed when
a window covers it whose word sequence also starts earlier: in a smaller doc_id,
or earlier in the same document. Windows are judged on the input.

1. Prefilter. Every chunk (:mod:`.chunks`) sketches its windows: ``depth`` rows
   of cells, as many cells as eight to sixteen times the windows of the whole
   input, so the sketch grows with the data. A sketch is sent as its occupied
   cells by cell range, with a bit where a cell counts two; ranges of all chunks
   are merged by adding (up to two), and each chunk gets back one bit per cell:
   two or more. No part of the sketch is gathered on one machine.
2. A window is estimated repeated if all its cells count two or more. The sketch
   only overestimates, so none is lost. Documents without such a window are
   final there and then.
3. Exact pass. Each chunk sends, once per distinct estimated window, a
   fingerprint (its cell and 64 further bits of independently hashed words) and
   its earliest place; per cell range the earliest place of all wins, and each
   chunk gets back one bit per window: does it start earlier elsewhere? A copied
   passage counts once per chunk, so a hot passage is at most one entry a chunk.
4. The chunk's remaining documents drop the covered words.

Defined cases: null and empty texts have no words; documents shorter than a
window lose nothing; null doc_ids precede all others and are reported as null;
rows that repeat a doc_id are judged as one document's alternatives (a window at
the same place of the same id isn't earlier); extra columns are ignored; very
long texts are whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .chunks import NO_ID, Chunk, encoded, loaded, loosen, pack_bits, pack_small, pack_sorted, squeeze, text_volume, unpack_bits, unpack_small, unpack_sorted, with_answers
from .common import materialize, mix

WINDOW = 20


class Plan:
    """Sizes shared by all tasks: 2**bits cells a row, cut into 2**cut ranges."""

    def __init__(self, volume: int, window: int, depth: int):
        self.window, self.depth = window, depth
        self.bits = max(10, math.ceil(math.log2(volume)) + 2)  # the volume is an upper bound, about twice the words
        self.cut = max(0, min(self.bits - 8, math.ceil(math.log2(volume / 4_000_000)) if volume > 4_000_000 else 0))
        self.coef = [mix(np.arange(1 + 1000 * r, window + 1 + 1000 * r, dtype=np.uint64)) | np.uint64(1) for r in range(2)]


def _hashes(c: Chunk, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window key, fingerprint, position of the window's first word) of every window within a document."""
    w, n = plan.window, len(c.tokens)
    if n < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, c.words)), dtype="<u8").reshape(-1, 2)
    ends = np.cumsum(c.lens)
    left = np.repeat(ends, c.lens) - np.arange(n)  # words from here to the document's end
    at = np.flatnonzero(left >= w)
    sums = []
    for r in range(2):
        h = np.ascontiguousarray(table[:, r])[c.tokens]
        s = np.zeros(n - w + 1, dtype=np.uint64)
        for j in range(w):
            s += h[j : n - w + 1 + j] * plan.coef[r][j]
        sums.append(mix(s[at]))
    return sums[0], sums[1], at


def _cells(key: np.ndarray, row: int, plan: Plan) -> np.ndarray:
    return (key if row == 0 else mix(key + np.uint64(row))) >> np.uint64(64 - plan.bits)


def _ranges(cells: np.ndarray, plan: Plan) -> list[tuple[int, int, int]]:
    """(range, from, to) slices of ascending cells."""
    edges = np.arange((1 << plan.cut) + 1, dtype=np.uint64) << np.uint64(plan.bits - plan.cut)
    at = np.searchsorted(cells, edges).tolist()
    return [(k, i, j) for k, (i, j) in enumerate(zip(at, at[1:])) if i < j]


def sketch(chunks: DataFrame, plan: Plan) -> DataFrame:
    """(part int, chunk long, cells binary, twice binary): the occupied cells of each chunk by row and range."""

    def run(batches):
        for c in loaded(batches):
            key, _, _ = _hashes(c, plan)
            for row in range(plan.depth):
                cells, counts = np.unique(_cells(key, row, plan), return_counts=True)
                found = [((row << plan.cut) + k, pack_sorted(cells[i:j]), pack_bits(counts[i:j] > 1)) for k, i, j in _ranges(cells, plan)]
                if found:
                    part, a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([c.name] * len(part), pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["part", "chunk", "cells", "twice"])

    return chunks.select("chunk", "body").mapInArrow(run, "part int, chunk long, cells binary, twice binary")


def merge(sketches: DataFrame) -> DataFrame:
    """(chunk, part, often binary): for each chunk's cells, whether all chunks together count two or more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells = [unpack_sorted(x) for x in rows["cells"]]
        both = np.concatenate(cells)
        values, at = np.unique(both, return_inverse=True)
        total = np.bincount(at, 1.0 + np.concatenate([unpack_bits(x) for x in rows["twice"]]), minlength=len(values))
        often, stop = total[at] > 1, np.cumsum([len(x) for x in cells])
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "often": [pack_bits(x) for x in np.split(often, stop[:-1])]})

    return sketches.groupBy("part").applyInPandas(run, "chunk long, part int, often binary")


def _suspects(c: Chunk, parts: list[int], often: list[bytes], plan: Plan):
    """(key, fingerprint, position) of the windows whose cells all count two or more."""
    key, fp, at = _hashes(c, plan)
    bits = dict(zip(parts, often))
    ok = np.ones(len(key), dtype=bool)
    for row in range(plan.depth):
        cells, where = np.unique(_cells(key, row, plan), return_inverse=True)
        flags = np.zeros(len(cells), dtype=bool)
        for k, i, j in _ranges(cells, plan):
            flags[i:j] = unpack_bits(bits[(row << plan.cut) + k])  # of another length only if the chunk changed, which raises
        ok &= flags[where]
    return key[ok], fp[ok], at[ok]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _order(c: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, start) of word positions."""
    ends = np.cumsum(c.lens)
    doc = np.searchsorted(ends, at, side="right")
    return c.doc_ids[doc], at - (ends - c.lens)[doc]


def _sorted_windows(c: Chunk, key, fp, at, plan: Plan):
    """Windows by (cell, fingerprint, doc_id, start), the first of each distinct window, and each window's distinct number."""
    cell = _cells(key, 0, plan)
    doc, start = _order(c, at)
    o = np.lexsort((start, doc, fp, cell))
    cell, fp, at, doc, start = cell[o], fp[o], at[o], doc[o], start[o]
    head = np.concatenate([[True], (cell[1:] != cell[:-1]) | (fp[1:] != fp[:-1])]) if len(o) else np.zeros(0, bool)
    return cell, fp, at, doc, start, np.flatnonzero(head), np.cumsum(head) - 1


_STEP = "kind int, doc_id long, n_words long, n_removed long, kept_sha256 string, chunk long, part int, a binary, b binary, c binary, d binary"
_FIELDS = [x.split()[0] for x in _STEP.split(", ")]
_RESULT = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=_FIELDS)
    for name in ("doc_id", "n_words", "n_removed", "chunk"):
        df[name] = df[name].astype("Int64")
    for name in ("kind", "part"):
        df[name] = df[name].astype("Int32")
    return df


def _final(c: Chunk, covered: np.ndarray) -> list[tuple]:
    """Result rows of a chunk's documents, given the mask of covered words."""
    out, stop = [], np.cumsum(c.lens).tolist()
    any_in = np.add.reduceat(np.append(covered, False), np.array(stop) - c.lens) * (c.lens > 0) if len(c.lens) else []
    for doc, n, e, k in zip(c.doc_ids.tolist(), c.lens.tolist(), stop, any_in):
        codes = c.tokens[e - n : e]
        kept = codes[~covered[e - n : e]] if k else codes
        out.append((0, None if doc == NO_ID else doc, n, n - len(kept), _sha([c.words[i] for i in kept.tolist()]), None, None, None, None, None, None))
    return out


def classify(chunks: DataFrame, answers: DataFrame, plan: Plan) -> DataFrame:
    """Kind 0: results of documents without a suspect. Kind 1: distinct suspects by range. Kind 2: a chunk's other documents (a) and the suspects' places in those (b), as bits."""

    def run(c: Chunk, got: pd.DataFrame) -> pd.DataFrame:
        key, fp, at = _suspects(c, got["part"].tolist(), got["often"].tolist(), plan)
        ends = np.cumsum(c.lens)
        marked = np.zeros(len(c.lens), dtype=bool)
        marked[np.searchsorted(ends, at, side="right")] = True
        rows = _final(c.take(~marked), np.zeros(int(c.lens[~marked].sum()), dtype=bool))
        if len(at):
            cell, f, _, doc, start, first, _ = _sorted_windows(c, key, fp, at, plan)
            cell, f, doc, start = cell[first], f[first], doc[first], start[first]
            for k, i, j in _ranges(cell, plan):
                rows.append((1, None, None, None, None, c.name, k, pack_sorted(cell[i:j]), squeeze(f[i:j].tobytes()), squeeze(np.ascontiguousarray(doc[i:j].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()), pack_small(start[i:j])))
            flags = np.zeros(len(c.tokens), dtype=bool)
            flags[at] = True
            rows.append((2, None, None, None, None, c.name, None, pack_bits(marked), pack_bits(flags[np.repeat(marked, c.lens)]), None, None))
        return _frame(rows)

    return with_answers(chunks, answers, run, _STEP)


def settle(suspects: DataFrame) -> DataFrame:
    """(chunk, part, later binary): for each chunk's distinct suspects, whether the window starts earlier in another chunk."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells = [unpack_sorted(x) for x in rows["a"]]
        cell, fp = np.concatenate(cells), np.concatenate([np.frombuffer(loosen(x), dtype=np.uint64) for x in rows["b"]])
        doc = np.concatenate([np.ascontiguousarray(np.frombuffer(loosen(x), dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel() for x in rows["c"]])
        start = np.concatenate([unpack_small(x) for x in rows["d"]]).astype(np.int64)
        o = np.lexsort((start, doc, fp, cell))
        head = np.concatenate([[True], (cell[o][1:] != cell[o][:-1]) | (fp[o][1:] != fp[o][:-1])])
        first = o[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = np.empty(len(o), dtype=bool)
        later[o] = (doc[o] > doc[first]) | (start[o] > start[first])
        stop = np.cumsum([len(x) for x in cells])
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "later": [pack_bits(x) for x in np.split(later, stop[:-1])]})

    return suspects.groupBy("part").applyInPandas(run, "chunk long, part int, later binary")


def finish(chunks: DataFrame, rest: DataFrame, answers: DataFrame, plan: Plan) -> DataFrame:
    """Results of the documents that have suspects. ``rest``: the rows of kind 2."""

    def run(c: Chunk, got: pd.DataFrame) -> pd.DataFrame:
        head = got[got["part"].isna()]
        if not len(head):
            return _frame([])[_RESULT]
        c, suspect = c.take(unpack_bits(head["a"].iloc[0])), unpack_bits(head["b"].iloc[0])
        got = got[got["part"].notna()]
        key, fp, at = _hashes(c, plan)
        mine = suspect[at]
        cell, _, at, doc, start, first, number = _sorted_windows(c, key[mine], fp[mine], at[mine], plan)
        later = np.zeros(len(first), dtype=bool)
        bits = dict(zip(got["part"].astype(int).tolist(), got["a"].tolist()))
        for k, i, j in _ranges(cell[first], plan):
            later[i:j] = unpack_bits(bits[k])
        gone = later[number] | (doc > doc[first][number]) | (start > start[first][number])
        step = np.zeros(len(c.tokens) + 1, dtype=np.int64)
        np.add.at(step, at[gone], 1)
        np.add.at(step, at[gone] + plan.window, -1)
        return _frame(_final(c, np.cumsum(step)[:-1] > 0))[_RESULT]

    both = rest.select("chunk", "part", "a", "b").unionByName(answers.select("chunk", "part", F.col("later").alias("a"), F.lit(None).cast("binary").alias("b")))
    return with_answers(chunks, both, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW, depth: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    volume = text_volume(docs)
    plan = Plan(volume, window, depth)
    chunks = encoded(docs, volume)
    answers = merge(sketch(chunks, plan))
    step = materialize(classify(chunks, answers, plan), "substring")
    later = settle(step.where("kind = 1").select("chunk", "part", "a", "b", "c", "d"))
    rest = finish(chunks, step.where("kind = 2"), later, plan)
    return step.where("kind = 0").select(*_RESULT).unionByName(rest)
