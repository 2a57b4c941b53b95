"""Token-id output with Re-Pair grammar compression.

Every whole text is encoded with a tokenizers vocabulary, the end id is appended,
and documents are laid out in ascending doc_id order (range-partitioned, then
sorted within partitions). Runs of whole documents of about ``block_ids`` ids
form blocks. In a block, frequent adjacent id pairs are repeatedly replaced by
nonterminals: each round counts all pairs, ranks those of ``min_count`` or more,
and replaces, where candidates overlap, the more frequent one. Pairs never cross
a document's end, so each document decodes by itself.

File format: a Parquet table with a row per block: shard int, block int, n_ids
long, doc_ids (little-endian int64, null ids as the smallest int64), symbols
(uint32 symbols per document), first_rule int, rules (uint32 pairs; symbol
``first_rule + r`` stands for pair r), lengths (uint32 expansion length of each
rule), body (symbols, uint16 if all fit, else uint32) and width int. A shard is a
range of doc_ids and blocks follow each other within it.

Where the vocabulary's normaliser and splitter never join text across ASCII white
space (:data:`BY_WORDS` lists the settings known for that), a text's ids are those
of its words in turn, and parts of words are remembered per worker in a bounded
cache; with any other vocabulary texts are encoded whole. Defined cases: null counts
as empty (the end id alone); null doc_ids come first; rows that repeat a doc_id
follow each other by a hash of their text, so that they can be split over shards;
a document longer than a block is a block; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, parts_for

DEFAULT_VOCABULARY = "word_bpe_49k.json"
END = 1
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NO_ID = -(1 << 63)
#: Normaliser and splitter with which words are encoded one by one: composed, lower-case text; runs of letters, single digits, runs of other marks.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Bytes of text in a shard, and so in a task.
SHARD_BYTES = 64 << 20
_BLOCK = "shard int, block int, n_ids long, doc_ids binary, symbols binary, first_rule int, rules binary, lengths binary, body binary, width int"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


class Encoder:
    """uint32 ids of texts. A batch's distinct words are cut into letters and the ASCII punctuation after them where the
    vocabulary's own splitter does so too; distinct parts are encoded once and remembered per worker, within ``limit``.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.limit = Tokenizer.from_file(path), {}, limit
        self.size = self.tokenizer.get_vocab_size()
        settings = json.loads(self.tokenizer.to_str())
        self.by_words = {k: settings[k] for k in BY_WORDS} == BY_WORDS and settings["post_processor"] is None
        self.splits: dict[str, bool] = {}
        self.ends_word = np.zeros(self.size, dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = piece.endswith("</w>")

    def _one_by_one(self, texts: list[str]) -> None:
        self.known.update(zip(texts, [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]))

    def _learn(self, parts: list[str]) -> None:
        letters = [x for x in parts if x.isalpha()]
        self._one_by_one([x for x in parts if not x.isalpha()])
        for k in range(0, len(letters), 512):  # a word of letters is one run of merges, which ends with a word-end piece
            part = letters[k : k + 512]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            stop = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stop) == len(part):
                raw, at = ids.tobytes(), [0, *(4 * stop).tolist()]
                self.known.update(zip(part, [raw[i:j] for i, j in zip(at, at[1:])]))
            else:
                self._one_by_one(part)

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        got = list(map(self.known.get, parts))
        if None in got:
            new = [x for x, g in zip(parts, got) if g is None]
            if len(self.known) + len(new) > self.limit:
                self.known = {x: g for x, g in zip(parts, got) if g is not None}  # what this batch holds stays
            self._learn(new)
            got = [self.known[x] if g is None else g for x, g in zip(parts, got)]
        return got

    def _split_before_mark(self, core: str) -> bool:
        """Whether the splitter parts ``core`` from a mark after it: a letter's normal form may end in a combining mark, which stays with the mark."""
        got = self.splits.get(core)
        if got is None:
            if len(self.splits) > self.limit:
                self.splits.clear()
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(core + "!"))
            got = self.splits[core] = len(cut) == 2 and cut[1][0] == "!"
        return got

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array([*e.ids, END], dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        if not self.by_words:
            return self._whole([t or "" for t in texts.to_pylist()])
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        owner, flat = pc.list_parent_indices(lists), lists.flatten()
        there = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(there).dictionary_encode()
        counts = np.bincount(owner.filter(there).to_numpy(), minlength=len(texts))
        words, tokens = coded.dictionary, coded.indices.to_numpy()
        core = pc.utf8_rtrim(words, characters=PUNCTUATION)
        cut = pc.utf8_is_alpha(core)
        odd = pc.and_(pc.and_(cut, pc.invert(pc.string_is_ascii(core))), pc.less(pc.binary_length(core), pc.binary_length(words)))
        if pc.any(odd).as_py():
            joined = np.zeros(len(words), dtype=bool)
            joined[np.flatnonzero(odd.to_numpy(zero_copy_only=False))] = [not self._split_before_mark(c) for c in core.filter(odd).to_pylist()]
            cut = pc.and_(cut, pa.array(~joined))
        core = pc.if_else(cut, pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core), words)
        tailed = pc.and_(cut, pc.less(pc.binary_length(core), pc.binary_length(words)))
        tails = [w[n:] for w, n in zip(words.filter(tailed).to_pylist(), pc.utf8_length(core.filter(tailed)).to_pylist())]
        parts = pa.concat_arrays([core, pa.array(tails, pa.large_string())]).dictionary_encode()
        packed = [*self._ids_of(parts.dictionary.to_pylist()), b"", np.array([END], dtype="<u4").tobytes()]
        first = parts.indices.to_numpy()
        second = np.full(len(words), len(packed) - 2, dtype=first.dtype)
        second[tailed.to_numpy(zero_copy_only=False)] = first[len(words) :]
        stops = np.cumsum(counts)
        seq = np.insert(np.stack([first[: len(words)][tokens], second[tokens]], 1).ravel(), 2 * stops, len(packed) - 1)
        length = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        n = length[seq]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(packed), dtype="<u4")[np.repeat((np.cumsum(length) - length)[seq] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return np.split(ids, ends[2 * stops + np.arange(len(stops))][:-1]) if len(texts) else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int, min_count: int = 8, min_gain: float = 0.01, per_round: int = 4096):
    """(symbols, document end flags, rules): Re-Pair until no pair is frequent, a round gains under ``min_gain``, or 16-bit symbols run out."""
    seq, last = ids.astype(np.uint32), ends.copy()
    rules = np.zeros((0, 2), dtype=np.uint32)
    room = (1 << 16) - first_rule if first_rule < (1 << 16) - 256 else (1 << 31)
    bits = 17

    def slots(key: np.ndarray) -> np.ndarray:
        size = key.dtype.itemsize * 8
        return key * key.dtype.type(0x9E3779B97F4A7C15 >> (64 - size)) >> key.dtype.type(size - bits)

    while len(seq) > 1 and len(rules) < room:
        key = (seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]) if first_rule + len(rules) >= (1 << 16) else (seq[:-1] << np.uint32(16) | seq[1:])
        key = np.where(last[:-1], key.dtype.type(0), key)  # a pair across documents; the pair (0, 0) isn't replaced either
        order = np.sort(key)
        start = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        count = np.diff(np.append(start, len(order)))
        often = np.flatnonzero((count >= min_count) & (order[start] != 0))
        if not len(often):
            break
        take = min(per_round, room - len(rules), len(often))
        if take < len(often):
            often = often[np.argpartition(-count[often], take - 1)[:take]]
        often = often[np.lexsort((order[start[often]], -count[often]))]
        pairs = order[start[often]]
        slot = slots(pairs)
        _, firsts = np.unique(slot, return_index=True)  # of two pairs in a slot the more frequent one; the other waits a round
        firsts.sort()
        pairs, slot = pairs[firsts], slot[firsts]
        rank_at = np.full(1 << bits, len(pairs), dtype=np.int32)
        rank_at[slot] = np.arange(len(pairs), dtype=np.int32)
        rank = rank_at[slots(key)]
        none = np.int32(len(pairs))
        hit = np.flatnonzero(rank < none)
        hit = hit[pairs[rank[hit]] == key[hit]]
        r = rank[hit]
        near = np.diff(hit) == 1
        lower_left = np.concatenate([[True], ~near | (r[1:] < r[:-1])])
        lower_right = np.concatenate([~near | (r[:-1] <= r[1:]), [True]])
        run = np.concatenate([[False], near & (r[1:] == r[:-1])])  # aaaa: every second one of a run of equal pairs
        if run.any():
            head = np.maximum.accumulate(np.where(run, 0, np.arange(len(hit))))
            even = (np.arange(len(hit)) - head) % 2 == 0
            chosen = np.where(run, even, lower_left) & lower_right
            both = np.flatnonzero(chosen[1:] & chosen[:-1] & near) + 1
            chosen[both] = False
        else:
            chosen = lower_left & lower_right
        hit, r = hit[chosen], r[chosen]
        uses = np.bincount(r, minlength=len(pairs))
        good = uses >= 2
        if len(hit) < max(1, min_gain * len(seq)) or not good.any():
            break
        hit, r = hit[good[r]], r[good[r]]
        number = np.cumsum(good) - 1 + first_rule + len(rules)
        wide = key.dtype.itemsize == 8
        p = pairs[good].astype(np.uint64)
        shift = np.uint64(32 if wide else 16)
        rules = np.concatenate([rules, np.stack([p >> shift, p & ((np.uint64(1) << shift) - np.uint64(1))], 1).astype(np.uint32)])
        seq[hit] = number[r].astype(np.uint32)
        last[hit] = last[hit + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[hit + 1] = False
        seq, last = seq[keep], last[keep]
    return seq, last, rules


def _generations(rules: np.ndarray, first_rule: int):
    """(from, to) runs of rules that refer to earlier runs only."""
    newest, i = rules.max(1).astype(np.int64) - first_rule, 0
    while i < len(rules):
        late = np.flatnonzero(newest[i:] >= i)
        j = i + int(late[0]) if len(late) else len(rules)
        yield i, j
        i = j


def _lengths_of(symbols: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    rule = symbols.astype(np.int64) - first_rule
    return np.where(rule >= 0, np.append(lengths, np.uint32(1))[np.where(rule >= 0, rule, -1)], 1).astype(np.int64)


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    out = np.ones(len(rules), dtype=np.uint32)
    for i, j in _generations(rules, first_rule) if len(rules) else ():
        out[i:j] = _lengths_of(rules[i:j], out, first_rule).sum(1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that ``symbols`` stand for: every nonterminal's expansion is laid out once, then gathered by its length."""
    at = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    flat = np.zeros(int(at[-1]) + 1, dtype=np.uint32)

    def gather(seq: np.ndarray) -> np.ndarray:
        n = _lengths_of(seq, lengths, first_rule)
        rule = seq.astype(np.int64) - first_rule
        table = np.concatenate([flat, seq.astype(np.uint32)])  # an id stands for itself
        start = np.where(rule >= 0, at[np.maximum(rule, 0)], np.arange(len(flat), len(table)))
        return table[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    for i, j in _generations(rules, first_rule) if len(rules) else ():
        flat[at[i] : at[j]] = gather(rules[i:j].ravel())
    return gather(symbols)


def _gathered(batches, least: int = 16 << 20):
    """(doc ids, texts) of neighbouring batches, together once they hold ``least`` bytes: fewer words are met twice."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield [i for x in held for i in x.column(0).to_pylist()], pa.concat_arrays([x.column(1) for x in held])
            held, size = [], 0
    if held:
        yield [i for x in held for i in x.column(0).to_pylist()], pa.concat_arrays([x.column(1) for x in held])


def write(docs: DataFrame, path: str | None = None, block_ids: int = 1 << 20) -> DataFrame:
    """Encode, lay out, compress and write ``docs``; the written blocks are returned."""
    path = path or default_path()

    def run(batches):
        shard, block = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int] = []

        def flush():
            nonlocal held, names, block
            lens = np.array([len(h) for h in held])
            ids = np.concatenate(held)
            ends = np.zeros(len(ids), dtype=bool)
            ends[np.cumsum(lens) - 1] = True
            first = encoder(path).size
            seq, last, rules = compress(ids, ends, first)
            width = 2 if not len(seq) or int(seq.max()) < 1 << 16 else 4
            row = (shard, block, len(ids), np.array(names, "<i8").tobytes(), np.diff(np.append(-1, np.flatnonzero(last))).astype("<u4").tobytes(), first,
                   rules.astype("<u4").tobytes(), expansion_lengths(rules, first).astype("<u4").tobytes(), seq.astype(f"<u{width}").tobytes(), width)
            held, names, block = [], [], block + 1
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[f.split()[0] for f in _BLOCK.split(", ")])

        size = 0
        for doc_ids, texts in _gathered(batches):
            for name, ids in zip(doc_ids, encoder(path)(texts)):
                if held and size + len(ids) > block_ids:
                    yield flush()
                    size = 0
                held.append(ids)
                names.append(NO_ID if name is None else name)
                size += len(ids)
        if held:
            yield flush()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the rows of one doc_id may be many: their texts' hash, then their place in the scan, let a range be cut among them
    spread = named.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    laid = spread.repartitionByRange(parts_for(docs.sparkSession, size, SHARD_BYTES), "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return materialize(laid.mapInArrow(run, _BLOCK), "token-blocks")


def read_block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids per document, all ids) of one block."""
    rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
    lengths = np.frombuffer(row["lengths"], dtype="<u4")
    body = np.frombuffer(row["body"], dtype=f"<u{row['width']}").astype(np.uint32)
    symbols = np.frombuffer(row["symbols"], dtype="<u4").astype(np.int64)
    ids = expand(body, rules, lengths, row["first_rule"])
    total = np.concatenate([[0], np.cumsum(_lengths_of(body, lengths, row["first_rule"]))])
    stops = np.cumsum(symbols)
    return np.frombuffer(row["doc_ids"], dtype="<i8"), total[stops] - total[stops - symbols], ids


def decode_document(row, index: int) -> np.ndarray:
    """The ids of one document of a block: only its own symbols are expanded."""
    symbols = np.frombuffer(row["symbols"], dtype="<u4").astype(np.int64)
    stop = int(symbols[: index + 1].sum())
    body = np.frombuffer(row["body"], dtype=f"<u{row['width']}")[stop - int(symbols[index]) : stop].astype(np.uint32)
    return expand(body, np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2), np.frombuffer(row["lengths"], dtype="<u4"), row["first_rule"])


def report(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks read back."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                names, lens, ids = read_block(row)
                raw, at = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(lens)])
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(at[:-1]), pa.array([None if x == NO_ID else x for x in names.tolist()], pa.int64()), pa.array(lens), pa.array(crc, pa.int64())],
                    names=["shard", "block", "at", "doc_id", "n_tokens", "ids_crc32"],
                )

    rows = blocks.mapInArrow(run, "shard int, block int, at long, doc_id long, n_tokens long, ids_crc32 long")
    # one small row per block (a million ids) and per shard: running totals within a shard, then over the shards
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before"))
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    starts = sizes.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("base")).alias("from"))
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
