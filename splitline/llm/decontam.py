"""Benchmark decontamination by template canonicalisation.

A text becomes template tokens: its whitespace-separated words, outer punctuation
stripped and lower-cased, where numbers, units and names are typed placeholders
(``<num>``, ``<unit>``, ``<name>``; a name is a capitalised word, and a run of
names within a sentence is one slot). A capitalised word that starts a sentence
may be a name or not, so there are two readings: in the plain one it is a
literal, in the open one a name, unless it is one of ``OPENERS``. Windows of
``n`` template tokens of every benchmark item are hash-joined, in both readings,
with the windows of every whole document. For each (document, item, diagonal)
the share of the item's windows found is its coverage, once over plain windows
alone and once, by the open reading's positions, over the windows of either
reading. Slots must be consistent: one slot value of the item stands for one
value in the document throughout. Matches of at least ``coverage`` are leaks,
re-parameterised ones included.

Two fixed one-megabyte bitmaps over different bits of the item windows' keys spare
windows that can't match; the exact join decides. Defined cases: null or empty texts and items have no
windows; an item of fewer than ``n`` tokens is one window of its own length;
windows with fewer literal tokens than placeholders don't count; an item whose
windows all fail that, such as a bare sum, is sought by exact windows of its words
instead, which placeholders don't touch; repeated items and documents each report; a
leak that repeats in a document reports its best diagonal, the plain reading
before the open one at equal coverage. Extra columns are
ignored by :func:`leaks` and kept by :func:`decontaminate`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import bitmap
from .common import materialize, mix, text_bytes

WINDOW = 8
STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: English number words and common unit names.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers inch inches foot feet yard yards mg g kg gram grams kilogram kilograms oz lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kph dollar dollars cent cents euro euros percent degree degrees".split()
)
#: Words that start sentences and are no names: in both readings literals.
OPENERS = frozenset(
    "a an the this that these those there here it its i you he she we they my your his her our their who whom whose what which when where why how if in on at by for from to of off with without within under over after before during since until while as because although though and but or nor so yet then than thus hence now once is are was were am be been do does did has have had can could will would shall should may might must not no yes all any both each every either neither some many much more most few several such same other another one only also however therefore suppose given let find calculate compute determine consider assume show prove explain write name list use choose"
    " der die das ein eine und oder wie was wer wo wann warum wenn le la les un une des et ou que qui comment pourquoi quand si el los las una y o que quien como cuando donde por para".split()
)
NUMBER = re.compile(r"[0-9][0-9.,/:]*(st|nd|rd|th)?$")
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
_STRIP, _ENDS, _NUMBER = STRIP.encode(), frozenset(b".!?:"), re.compile(NUMBER.pattern.encode())
_NUMBER_WORDS, _UNITS, _OPENERS = (frozenset(w.encode() for w in words) for words in (NUMBER_WORDS, UNITS, OPENERS))
_SLOT_HASH = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_COEF = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


class Canonicalizer:
    """Word properties by id: hash, kind, capitalised, ends a sentence, no opener. Forgotten when large."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.ids: dict[bytes, int] = {}
        self.new: list[tuple] = []
        self.table = [np.zeros(1024, np.uint64), np.zeros(1024, np.int8), np.zeros(1024, bool), np.zeros(1024, bool), np.zeros(1024, bool)]

    def _add(self, word: bytes) -> int:
        if word.isascii():  # the same on bytes
            core = word.strip(_STRIP)
            low = core.lower()
            kind = NUM if low in _NUMBER_WORDS or core[:1].isdigit() and _NUMBER.match(core) else UNIT if low in _UNITS else LITERAL
            self.new.append((xxhash.xxh64_intdigest(low), kind, core.isalpha() and core.istitle(), word[-1] in _ENDS, low not in _OPENERS))
            i = self.ids[word] = len(self.ids)
            return i
        text = word.decode("utf-8", "replace")
        core = text.strip(STRIP)
        low = core.lower()
        kind = NUM if low in NUMBER_WORDS or core[:1].isdigit() and NUMBER.match(core) else UNIT if low in UNITS else LITERAL
        self.new.append((xxhash.xxh64_intdigest(low), kind, core.istitle() and core.isalpha(), text[-1] in ".!?:", low not in OPENERS))
        i = self.ids[word] = len(self.ids)
        return i

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        """Hashes of the words' cores, after :meth:`tokens` has seen them."""
        return self.table[0][np.array([self.ids[w] for w in words], dtype=np.int64)]

    def tokens(self, words: list[bytes], opens: np.ndarray | None = None):
        """[(hashes, kinds, first word, end word)] of the template tokens of one text, by reading: plain, then open.

        ``opens``: places of the first words, where ``words`` are several texts in a row.
        """
        get, add = self.ids.get, self._add
        ids = np.array([add(w) if (i := get(w)) is None else i for w in words], dtype=np.int64)
        if self.new:
            n, m = len(self.ids), len(self.ids) - len(self.new)
            while n > len(self.table[0]):
                self.table = [np.concatenate([t, np.zeros_like(t)]) for t in self.table]
            for t, v in zip(self.table, zip(*self.new)):
                t[m:n] = v
            self.new = []
        word, own, capital, ends, free = (t[ids] for t in self.table)
        start = np.concatenate([[True], ends[:-1]])
        if opens is not None:
            start[opens] = True
        out = []
        for name in (capital & ~start, capital & (~start | free)):
            kind = np.where((own == LITERAL) & name, NAME, own)
            h = np.where(kind == LITERAL, word, _SLOT_HASH[kind])
            first = np.flatnonzero(~((kind == NAME) & ~start & np.concatenate([[False], kind[:-1] == NAME])))
            out.append((h[first], kind[first], first, np.append(first[1:], len(words))))
        return out


def window_keys(h: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
    """Key of each window of ``n`` tokens, 0 where placeholders outnumber literals."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = np.full(m, n, dtype=np.uint64)
    for j in range(n):
        x += h[j : j + m] * _COEF[j]
    slots = np.concatenate([[0], np.cumsum(kind != LITERAL)])
    return np.where(slots[n:] - slots[:-n] > n // 2, np.uint64(0), mix(x))


def _slot_values(words, kind, first, end, at: int, n: int) -> list[str]:
    return [b" ".join(words[first[j] : end[j]]).decode("utf-8", "replace").strip(STRIP).lower() for j in range(at, at + n) if kind[j] != LITERAL]


_WINDOWS = "n int, key long, pos int, total int, open_pos int, open_total int, slots array<string>, exact boolean"
_EXACT = np.uint64(0xD6E8FEB86659FD93)


def exact_keys(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of the windows of ``n`` words as they stand."""
    x = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64) ^ _EXACT
    for j in range(n):
        x += h[j : j + len(x)] * _COEF[j]
    return mix(x)


def _windows_of(texts: list[bytes], lengths: list[int] | None, exact: list[int], keep, canon: Canonicalizer):
    """Rows (row, n, key, pos, total, open_pos, open_total, slots, exact); lengths None: an item's own windows. A position is -1 in a reading without the window.

    ``exact``: the lengths of exact windows to look for in documents.
    """
    for row, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        if len(canon.ids) > 200_000:
            canon.clear()
        plain, opened = canon.tokens(words)
        templates = False
        sizes = [min(WINDOW, len(r[0])) for r in (plain, opened)]
        for n in lengths or sorted(set(sizes)):
            uses = [lengths is not None or n == size for size in sizes]
            keys, open_keys = (window_keys(r[0], r[1], n) if use else np.zeros(0, np.uint64) for r, use in zip((plain, opened), uses))
            # every first word of the open reading is one of the plain reading too; a plain window that starts within an open name has no open position
            at = np.full(len(plain[2]), -1)
            if uses[1]:
                at[np.searchsorted(plain[2], opened[2])] = np.arange(len(opened[2]))
            same = np.searchsorted(plain[2], opened[2][: len(open_keys)])
            new = open_keys != 0
            inside = np.flatnonzero(same < len(keys))
            new[inside] &= keys[same[inside]] != open_keys[inside]
            total = int((keys != 0).sum())
            both = np.union1d(at[: len(keys)][keys != 0], np.flatnonzero(open_keys))
            open_total = int((both >= 0).sum())
            templates = templates or total > 0 or open_total > 0
            ok, open_ok = keys != 0, new
            if keep:
                ok, open_ok = ok & keep(keys), open_ok & keep(open_keys)
            for p in np.flatnonzero(ok).tolist():
                yield row, n, int(keys[p].astype(np.int64)), p, total, int(at[p]), open_total, _slot_values(words, *plain[1:], p, n), False
            for p in np.flatnonzero(open_ok).tolist():
                yield row, n, int(open_keys[p].astype(np.int64)), -1, total, p, open_total, _slot_values(words, *opened[1:], p, n), False
        for n in exact if lengths is not None else [] if templates else [min(WINDOW, len(words))]:
            keys = exact_keys(canon.word_hashes(words), n)
            for p in (np.flatnonzero(keep(keys)) if keep else np.arange(len(keys))).tolist():
                yield row, n, int(keys[p].astype(np.int64)), p, len(keys), -1, 0, [], True


def _candidates(texts: list[bytes], lengths: list[int], exact: list[int], keep, canon: Canonicalizer) -> list[int]:
    """The texts that may hold a wanted window, all of a batch looked at together: one pass of array operations instead of one a text."""
    split = [t.split() for t in texts]
    if len(canon.ids) > 200_000:
        canon.clear()
    counts = np.array([len(w) for w in split], dtype=np.int64)
    words = [w for ws in split for w in ws]
    if not words:
        return []
    owner = np.repeat(np.arange(len(texts)), counts)
    opens = (np.cumsum(counts) - counts)[counts > 0]
    found = np.zeros(len(texts), dtype=bool)

    def look(keys: np.ndarray, n: int, own: np.ndarray) -> None:
        at = np.flatnonzero(keys)
        at = at[keep(keys[at])]
        at = at[own[at] == own[at + n - 1]]  # windows don't cross texts
        found[own[at]] = True

    for h, kind, first, _ in canon.tokens(words, opens):
        for n in lengths:
            look(window_keys(h, kind, n), n, owner[first])
    if exact:
        h = canon.word_hashes(words)
        for n in exact:
            look(exact_keys(h, n), n, owner)
    return np.flatnonzero(found).tolist()


LOW = 12


def _bitmaps(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return bitmap.build(keys, "key"), bitmap.build(keys, "key", LOW)


def windows(texts: DataFrame, id_column: str, lengths: list[int] | None = None, exact: list[int] = (), allowed: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(id, n, key, pos, total, open_pos, open_total, slots, exact) of the windows of every whole text; ``allowed``: bitmaps of wanted keys, see :func:`_bitmaps`."""
    shared = None if allowed is None else texts.sparkSession.sparkContext.broadcast([np.packbits(x).tobytes() for x in allowed])

    def run(batches):
        keep = None
        if shared is not None:
            high, low = (np.unpackbits(np.frombuffer(x, dtype=np.uint8)).view(bool) for x in shared.value)
            keep = lambda keys: high[bitmap.slots(keys)] & low[bitmap.slots(keys, LOW)]
        canon = Canonicalizer()
        for b in batches:
            ids = b.column(0).to_pylist()
            bodies = text_bytes(b.column(1))
            own = range(len(bodies)) if keep is None else _candidates(bodies, lengths, exact, keep, canon)
            rows = [(ids[own[r]], *x) for r, *x in _windows_of([bodies[i] for i in own], lengths, exact, keep, canon)]
            if rows:
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "n", "key", "pos", "total", "open_pos", "open_total", "slots", "exact"])

    return texts.select(F.col(id_column).cast("long").alias("id"), F.col("text")).mapInArrow(run, f"id long, {_WINDOWS}")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """doc_id, item_id, coverage, n_windows, n_slots, n_changed, reparameterised: one row per leaked item of a document."""
    items = materialize(windows(benchmark.where(F.col("item_id").isNotNull()), "item_id").dropDuplicates(["id", "n", "key", "pos", "open_pos"]), "items")
    sizes = [(r.n, r.exact) for r in items.select("n", "exact").distinct().collect()]  # at most 2 * WINDOW of them
    lengths, exact = (sorted(n for n, e in sizes if e == kind) for kind in (False, True))
    spark = docs.sparkSession
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, coverage double, n_windows long, n_slots long, n_changed long, reparameterised boolean")
    found = windows(docs.where(F.col("doc_id").isNotNull()), "doc_id", lengths, exact, _bitmaps(items))
    sides = lambda side: F.array(*[F.struct(F.lit(r).alias("reading"), F.col(p).alias(f"{side}_pos"), F.col(t).alias(f"{side}_total")) for r, p, t in ((0, "pos", "total"), (1, "open_pos", "open_total"))])
    i = items.select("n", "key", F.col("id").alias("item_id"), sides("item").alias("item_at"), F.col("slots").alias("item_slots"))
    d = found.select("n", "key", F.col("id").alias("doc_id"), sides("doc").alias("doc_at"), "slots")
    hits = d.join(i, ["n", "key"]).select("doc_id", "item_id", "slots", "item_slots", F.explode(F.arrays_zip("item_at", "doc_at")).alias("at"))
    hits = hits.where("at.item_at.item_pos >= 0 and at.doc_at.doc_pos >= 0").select(
        "doc_id", "item_id", "slots", "item_slots", "at.item_at.reading", "at.item_at.item_pos", "at.item_at.item_total", (F.col("at.doc_at.doc_pos") - F.col("at.item_at.item_pos")).alias("diagonal")
    )
    pairs = F.flatten(F.collect_set(F.transform(F.arrays_zip("item_slots", "slots"), lambda s: F.struct(s["item_slots"].alias("i"), s["slots"].alias("d")))))
    best = F.struct("coverage", F.negative("reading").alias("r"), "n_windows", F.negative("diagonal").alias("d"), "n_slots", "n_changed")
    # a group is one item along one diagonal in one reading: at most the item's own windows, twice
    return (
        hits.groupBy("doc_id", "item_id", "reading", "diagonal")
        .agg(F.countDistinct("item_pos").alias("n_windows"), F.first("item_total").alias("item_total"), F.array_distinct(pairs).alias("pairs"))
        .withColumn("n_slots", F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))).cast("long"))
        .where((F.col("n_windows") >= coverage * F.col("item_total")) & (F.size("pairs") == F.col("n_slots")))
        .withColumn("coverage", F.col("n_windows") / F.col("item_total"))
        .withColumn("n_changed", F.size(F.filter("pairs", lambda p: p["i"] != p["d"])).cast("long"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(best).alias("b"))
        .select("doc_id", "item_id", "b.coverage", "b.n_windows", "b.n_slots", "b.n_changed", (F.col("b.n_changed") > 0).alias("reparameterised"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """``docs`` without the documents that hold a leaked item; rows without doc_id stay."""
    bad = leaks(docs, benchmark, coverage).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_leaked"], "left_anti")
