"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a public vocabulary file (a parameter). That file ranks its
pieces, so a piece's log score is the Zipf-Mandelbrot log probability of its
rank, ``-log(rank + 2.7)`` normalised over the vocabulary; nothing is trained.
A text becomes a whitespace marker plus the text with spaces as markers; the best
segmentation is found by Viterbi over the trie's matches. A character that starts
no one-character piece costs the worst score less 10 and falls back to its UTF-8
bytes. A literal marker character also falls back to bytes, so that decoding
restores every text exactly.

No piece has a marker after another character, so a best path always breaks
before a marker run and a text is encoded segment by segment; segments are
remembered per worker in a bounded cache. Defined cases: null counts as empty,
an empty text has no pieces, whole texts are encoded however long, repeated rows
encode alike, extra columns are kept by :func:`encode` and :func:`decode`
(columns of the result's names are replaced).
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fresh, text_bytes

MARK = "▁"
MARK_B = MARK.encode()
#: Words remembered per worker, about 50 MB.
CACHE = 250_000
DEFAULT_MODEL = "piece_bpe_32k.model"


class DoubleArrayTrie:
    """base/check arrays over bytes; ``value`` holds the piece id of a node that ends a piece, else -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        tree: dict = {}
        for key, value in keys:
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 17
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        start, todo = 1, [(0, tree)]
        while todo:
            at, node = todo.pop()
            value[at] = node.get(-1, -1)
            codes = np.array(sorted(c for c in node if c >= 0), dtype=np.int64)
            if not len(codes):
                continue
            b = start
            while True:  # the first base at which every child's cell is free, 2,048 bases at a time
                if b + 2048 + 257 >= len(check):
                    base, check, value = (np.concatenate([x, np.full(size, fill, np.int64)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                free = np.logical_and.reduce([check[b + c + 1 : b + c + 1 + 2048] < 0 for c in codes])
                if free.any():
                    b += int(free.argmax())
                    break
                b += 2048
            base[at] = b
            check[b + codes + 1] = at
            todo += [(b + int(c) + 1, node[int(c)]) for c in codes]
            while (check[start + 1 : start + 257] >= 0).mean() > 0.9:  # nearly full: later searches start beyond
                start += 256
        base, check, value = base.tolist(), check.tolist(), value.tolist()
        self.base, self.check, self.value = base, check, value


class UnigramModel:
    """A vocabulary with log scores; built once per worker from the vocabulary file's rows."""

    def __init__(self, pieces: list[str], byte_ids: list[int], normal: list[int]):
        total = sum(1 / (i + 2.7) for i in range(len(normal)))
        self.scores = [0.0] * len(pieces)
        for rank, i in enumerate(normal):
            self.scores[i] = -math.log(rank + 2.7) - math.log(total)
        self.unknown = min(self.scores) - 10.0
        self.byte_ids, self.normal = byte_ids, normal
        self.pieces = pieces
        back = {b: i for b, i in enumerate(byte_ids)}
        self.bytes_of = [b""] * len(pieces)
        for i in normal:
            self.bytes_of[i] = pieces[i].replace(MARK, " ").encode()
        for b, i in back.items():
            self.bytes_of[i] = bytes([b])
        self.local = not any(MARK in p.lstrip(MARK) for p in (pieces[i] for i in normal))
        self.known: dict[bytes, bytes] = {}
        first = np.arange(256)
        self.width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))

    @cached_property
    def trie(self) -> DoubleArrayTrie:
        """Built at the first search: a worker that only decodes has none."""
        return DoubleArrayTrie([(self.pieces[i].encode(), i) for i in self.normal])

    @cached_property
    def arrays(self) -> tuple[np.ndarray, ...]:
        return (*(np.array(x, dtype=np.int64) for x in (self.trie.base, self.trie.check, self.trie.value)), np.array(self.scores))

    def viterbi(self, s: bytes, literal: frozenset[int] = frozenset()) -> list[int]:
        """Best piece ids of UTF-8 bytes ``s``; ``literal`` holds the starts of marker characters of the text itself."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(s)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -math.inf:
                continue
            c = s[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            single = False
            if i not in literal:
                node, j = 0, i
                while j < n and j not in literal:
                    nxt = base[node] + s[j] + 1
                    if check[nxt] != node or nxt == 0:
                        break
                    node = nxt
                    j += 1
                    v = value[node]
                    if v >= 0:
                        x = here + scores[v]
                        if x > best[j]:
                            best[j], back[j], piece[j] = x, i, v
                        single |= j == i + width
            if not single:
                j = min(n, i + width)
                x = here + self.unknown
                if x > best[j]:
                    best[j], back[j], piece[j] = x, i, -1
        out: list[int] = []
        j = n
        while j:
            i = back[j]
            out += [piece[j]] if piece[j] >= 0 else [self.byte_ids[b] for b in reversed(s[i:j])]
            j = i
        return out[::-1]

    def viterbi_batch(self, words: list[bytes]) -> list[bytes]:
        """Packed best ids of many short marker-led words at once: the same search, one position of all words at a time."""
        base, check, value, score = self.arrays
        n, lens = len(words), np.array([len(w) for w in words])
        size = int(lens.max())
        text = np.frombuffer(b"".join(w.ljust(size + 1, b"\0") for w in words), dtype=np.uint8).reshape(n, size + 1).astype(np.int64)
        width = self.width[text]
        best = np.full((n, size + 5), -np.inf)
        back, piece = np.zeros((n, size + 5), np.int32), np.full((n, size + 5), -1, np.int32)
        best[:, 0] = 0.0
        for i in range(size):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (lens > i))
            if not len(rows):
                continue
            single, live, node, j = np.zeros(n, bool), rows, np.zeros(len(rows), np.int64), i
            while len(live):
                nxt = base[node] + text[live, j] + 1
                ok = (check[nxt] == node) & (lens[live] > j)
                live, node = live[ok], nxt[ok]
                j += 1
                v = value[node]
                end = v >= 0
                at, v = live[end], v[end]
                x = best[at, i] + score[v]
                better = x > best[at, j]
                at2 = at[better]
                best[at2, j], back[at2, j], piece[at2, j] = x[better], i, v[better]
                single[at[width[at, i] == j - i]] = True
            rows = rows[~single[rows]]
            j = np.minimum(i + width[rows, i], lens[rows])
            x = best[rows, i] + self.unknown
            better = x > best[rows, j]
            rows, j = rows[better], j[better]
            best[rows, j], back[rows, j], piece[rows, j] = x[better], i, -1
        out, byte_ids = [], self.byte_ids
        for w, b, p, j in zip(words, back.tolist(), piece.tolist(), lens.tolist()):
            ids: list[int] = []
            while j:
                if p[j] >= 0:
                    ids.append(p[j])
                else:
                    ids += [byte_ids[c] for c in reversed(w[b[j] : j])]
                j = b[j]
            ids.reverse()
            out.append(struct.pack(f"<{len(ids)}i", *ids))
        return out

    def learn(self, words: set[bytes]) -> None:
        """Remember the segments of ``words``; long ones and those with a marker are left to :meth:`segment`."""
        known = self.known
        if len(known) + len(words) > CACHE:
            known.clear()
        short = sorted((w for w in words if len(w) <= 64 and MARK_B not in w), key=len)
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            known.update(zip(part, self.viterbi_batch([MARK_B + w for w in part])))

    def segment(self, word: bytes) -> bytes:
        """Packed ids of the marker and ``word``."""
        return np.array(self.viterbi(MARK_B + word), dtype="<i4").tobytes()

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text; the new words of all of them are learnt together."""
        known, split, found, new = self.known, [t.split(b" ") for t in texts], [], set()
        for words in split:
            got = list(map(known.get, words))
            found.append(got)
            if None in got:
                new.update([w for w, g in zip(words, got) if g is None])
        self.learn(new)
        out = []
        for text, words, got in zip(texts, split, found):
            if MARK_B in text or b"  " in text or not text or text[:1] == b" " or text[-1:] == b" " or not self.local:
                out.append(self.encode(text))
            else:
                out.append(b"".join([known.get(w) or self.segment(w) if g is None else g for w, g in zip(words, got)] if None in got else got))
        return out

    def _marked(self, lead: bytes, word: bytes) -> bytes:
        """Packed ids of ``lead`` markers and a word that holds literal markers: no piece has one, so the parts between them are searched alone."""
        out, parts = [], word.split(MARK_B)
        literal = np.array([self.byte_ids[b] for b in MARK_B], dtype="<i4").tobytes()
        for k, part in enumerate(parts):
            if k:
                out.append(literal)
            if part or not k:
                out.append(np.array(self.viterbi(lead + part if not k else part), dtype="<i4").tobytes())
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Packed little-endian int32 ids of a whole text."""
        if not text:
            return b""
        if not self.local:  # pieces with a marker inside: the text is one segment
            s = MARK_B + text.replace(b" ", MARK_B)
            at, literal = 3, set()
            for c in text.decode():
                if c == MARK:
                    literal.add(at)
                at += 3 if c == " " else len(c.encode())
            return np.array(self.viterbi(s, frozenset(literal)), dtype="<i4").tobytes()
        known, out = self.known, []
        for run, word in re.findall(rb"( +)([^ ]*)", b" " + text):
            if MARK_B in word:
                out.append(self._marked(MARK_B * len(run), word))
            elif len(run) == 1:
                out.append(known.get(word) or self.segment(word))
            else:
                out.append(np.array(self.viterbi(MARK_B * len(run) + word), dtype="<i4").tobytes())
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """Pieces joined, markers as spaces, byte pieces as their bytes, the leading marker dropped."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]


def vocabulary(path: str) -> tuple[list[str], list[int], list[int]]:
    """Pieces, ids of the 256 byte pieces, ids of the ordinary pieces in rank order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = [i for i in range(n) if sp.is_byte(i)]
    normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return pieces, byte_ids, normal


_MODELS: dict[str, UnigramModel] = {}


def model_at(path: str) -> UnigramModel:
    """The model of a vocabulary file that every machine has, once per worker."""
    if path not in _MODELS:
        _MODELS[path] = UnigramModel(*vocabulary(path))
    return _MODELS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids`` array<int>, ``n_pieces`` long and ``ids_crc32`` long (of the little-endian 32-bit ids)."""
    path = path or default_path()

    @F.arrow_udf(T.StructType([T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType())]))
    def run(col: pa.Array) -> pa.Array:
        m, texts, packed = model_at(path), text_bytes(col), []
        for k in range(0, len(texts), 256):
            packed += m.encode_all(texts[k : k + 256])
        lens = np.array([len(p) // 4 for p in packed], dtype=np.int64)
        values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), values, type=pa.list_(pa.field("element", pa.int32(), False)))
        crc = pa.array([zlib.crc32(p) for p in packed], pa.int64())
        return pa.StructArray.from_arrays([lists, pa.array(lens), crc], names=["piece_ids", "n_pieces", "ids_crc32"])

    names = ("piece_ids", "n_pieces", "ids_crc32")
    own = [c for c in docs.columns if c not in names]
    found = fresh(own, "found")
    got = docs.select(*[F.col(f"`{c}`") for c in own], run(F.col(f"`{text}`")).alias(found))
    return got.select(*[F.col(f"`{c}`") for c in own], *[F.col(found)[n].alias(n) for n in names])


def decode(encoded: DataFrame, path: str | None = None, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give an empty text."""
    path = path or default_path()

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        m = model_at(path)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        values, at = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))])
        return pa.array([m.decode(values[i:j].tolist()) for i, j in zip(at[:-1], at[1:])], pa.binary()).cast(pa.string())

    return encoded.withColumn(out, run(F.col(ids)))
