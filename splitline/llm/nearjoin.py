"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is the set of its five-word shingles (words are whitespace-separated
and unchanged; a text of one to four words is one shingle). Links are the pairs
of documents whose sets have a Jaccard similarity of ``threshold`` or more.

1. Documents with equal sets collapse to one representative, the smallest id;
   copies are never expanded into pairs.
2. The forest: each of ``trees`` prefix tries orders the representatives by a
   signature of ``depth`` MinHash values. A document starts with the full depth
   in every tree and shortens its prefix to the ``floor`` tree by tree, the
   emptiest bucket first, until a pair at the threshold meets it in some tree
   with probability ``recall`` (:func:`forest_shape`). Where its buckets are
   ``dense``, the densest trees so stay at full depth; small buckets are all
   taken at the floor, which only adds recall.
3. A representative's home is the smallest member of its full-depth buckets (else
   of its floor buckets). Homes are cut into blocks of ``block`` in trie order.
4. Verification within buckets: two blocks meet in one task where some bucket has
   members in both, and only the members of such buckets go there. A pair of
   representatives can only meet in the task of its two blocks, so it is verified
   once, from the whole shingle sets, however many buckets it shares. A task
   returns link counts and an edge from each linked member to the smallest one it
   hangs together with there.
5. Classes are the components of the verified links.

Only representatives that share a bucket are read again for their sets. Defined
cases: null and wordless texts have no shingles, are linked to nothing and are
their own class; a null doc_id takes no part; repeated rows of one doc_id count
as one document with the first text in text order; ties of ids can't occur then;
very long texts are whole; extra columns are ignored by :func:`classes` and kept
by :func:`deduplicate`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import bitmap
from .common import WordCache, materialize, mix, text_bytes
from .graph import components

SHINGLE = 5
_COEF = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct 64-bit shingle keys of a text's word hashes."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    m = max(1, n - SHINGLE + 1)
    x = np.full(m, min(n, SHINGLE), dtype=np.uint64)
    for j in range(min(n, SHINGLE)):
        x += words[j : j + m] * _COEF[j]
    return np.unique(mix(x))


def _hasher() -> WordCache:
    return WordCache(xxhash.xxh64_intdigest)


def forest_shape(trees: int, depth: int, threshold: float, recall: float) -> tuple[int, int]:
    """(floor, n): the longest prefix at which all trees together reach ``recall`` for a pair at the threshold, and how many
    trees must come down to it if the others stay at ``depth``."""
    need = -math.log(1 - recall)
    gain = lambda length: -math.log(1 - threshold**length)
    floor = depth
    while floor > 1 and trees * gain(floor) < need:
        floor -= 1
    if floor == depth:
        return floor, trees
    return floor, min(trees, max(0, math.ceil((need - trees * gain(depth)) / (gain(floor) - gain(depth)))))


def signatures(docs: DataFrame, trees: int, depth: int, floor: int) -> DataFrame:
    """(doc_id, set_key, n, prefixes, leaves) of the documents with shingles: per tree a key of the prefix at the floor and one at full depth."""
    a = (mix(np.arange(1, trees * depth + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    c = mix(np.arange(1_000_001, 1_000_001 + trees * depth, dtype=np.uint64)).astype(np.uint32)

    def run(batches):
        hashes = _hasher()
        for b in batches:
            ids, keys, sizes, prefixes, leaves = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                s = shingles(np.array(hashes(text.split()), dtype=np.uint64))
                if not len(s):
                    continue
                half = (s >> np.uint64(32)).astype(np.uint32)
                low = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
                for k in range(0, len(s), 1024):
                    low = np.minimum(low, (half[k : k + 1024, None] * a + c).min(0))
                low = low.reshape(trees, depth)
                key = np.arange(trees, dtype=np.uint64)
                for j in range(depth):
                    if j == floor:
                        prefixes.append(key.view(np.int64))
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, j])
                if floor == depth:
                    prefixes.append(key.view(np.int64))
                leaves.append(key.view(np.int64))
                ids.append(doc)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sizes.append(len(s))
            at = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * trees)
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if ids else np.zeros(0, np.int64))) for x in (prefixes, leaves)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "set_key", "n", "prefixes", "leaves"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_key binary, n long, prefixes array<long>, leaves array<long>")


def forest(of_rep: DataFrame, trees: int, n_floor: int, dense: int) -> DataFrame:
    """(rep, home, bucket, asks): the buckets of every representative that shares one. ``asks``: it chose this bucket itself.

    ``of_rep``: (rep, prefixes, leaves). A floor bucket holds all members of its prefix, of whom some ask; a full-depth
    bucket holds those who stay at full depth in its tree.
    """
    spread = of_rep.select("rep", F.explode(F.arrays_zip("prefixes", "leaves")).alias("t")).select("rep", F.col("t.prefixes").alias("prefix"), F.col("t.leaves").alias("leaf"))
    full = spread.groupBy("prefix").agg(F.count("*").alias("size"), F.min("rep").alias("star")).where("size > 1")
    member = materialize(spread.join(full, "prefix"), "forest")  # what shares no prefix ends here
    leaf = member.groupBy("leaf").agg(F.count("*").alias("leaf_size"), F.min("rep").alias("leaf_star")).where("leaf_size > 1")
    known = member.join(leaf, "leaf", "left")
    tree = F.struct("size", "prefix", "leaf", "star", "leaf_size", "leaf_star")
    per_rep = known.groupBy("rep").agg(F.array_sort(F.collect_list(tree)).alias("ts"))  # at most one row per tree
    # emptiest first: unshared trees come down to the floor for nothing, then the shared ones in order of size
    must = F.lit(n_floor - trees) + F.size("ts")
    chosen = F.transform("ts", lambda t, i: F.struct(t.alias("t"), ((i < must) | (t["size"] <= dense)).alias("down")))
    home = F.coalesce(F.array_min(F.transform("ts", lambda t: t["leaf_star"])), F.array_min(F.transform("ts", lambda t: t["star"])))
    rows = per_rep.select("rep", home.alias("home"), F.explode(chosen).alias("c")).select("rep", "home", "c.t.*", "c.down")
    floors = rows.select("rep", "home", F.col("prefix").alias("bucket"), F.col("down").alias("asks"))
    deep = rows.where("not down and leaf_size > 1").select("rep", "home", F.col("leaf").alias("bucket"), F.lit(True).alias("asks"))
    return floors.unionByName(deep)


def partners(placed: DataFrame) -> DataFrame:
    """(rep, b, partners): the blocks that have a member in a bucket of ``rep``, which is in block b; its own if another member is there too.

    ``placed``: (rep, b, bucket, asks). A bucket that nobody asks for, on either side, doesn't count. Lists are of blocks,
    never of documents, and every join is one row to one row.
    """
    at = placed.groupBy("bucket", "b").agg(F.bool_or("asks").alias("asks"), F.count("*").alias("n"))
    lists = at.groupBy("bucket").agg(F.collect_list(F.struct("b", "asks", "n")).alias("blocks"))
    met = F.filter("blocks", lambda x: (x["asks"] | F.col("asks")) & ((x["b"] != F.col("b")) | (x["n"] > 1)))
    near = placed.join(lists, "bucket").select("rep", "b", F.transform(met, lambda x: x["b"]).alias("met"))
    return near.groupBy("rep", "b").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("partners")).where(F.size("partners") > 0)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles binary) of the documents in ``wanted`` (rep): a fixed-size bitmap first, then the exact join."""
    hashed = wanted.select(F.xxhash64("rep").alias("k"))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap.build(hashed, "k")).tobytes())

    def near(batches):
        bits = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).view(bool)
        for b in batches:
            yield b.filter(pa.array(bits[bitmap.slots(b.column(0).to_numpy().view(np.uint64))])).select([1, 2])

    def run(batches):
        hashes = _hasher()
        for b in batches:
            found = [shingles(np.array(hashes(t.split()), dtype=np.uint64)).tobytes() for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["rep", "shingles"])

    maybe = docs.select(F.xxhash64("doc_id").alias("k"), "doc_id", "text").mapInArrow(near, "doc_id long, text string")
    # a repeated doc_id is one document already, see classes()
    return maybe.join(wanted, maybe["doc_id"] == wanted["rep"], "left_semi").mapInArrow(run, "rep long, shingles binary")


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sets reach the threshold; right None: pairs within ``left``."""
    both = left + (right or [])
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    values, code = np.unique(np.concatenate(both), return_inverse=True)
    often = np.bincount(code, minlength=len(values)) > 1
    owner, code = owner[often[code]], (np.cumsum(often) - 1)[code[often[code]]]
    width = int(often.sum())
    common = np.zeros((len(both), len(both)), dtype=np.float32)  # counts below 2**24 are exact
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for k in range(0, width, 8192):
        lo, hi = np.searchsorted(code, [k, k + 8192])
        m = np.zeros((len(both), min(8192, width - k)), dtype=np.float32)
        m[owner[lo:hi], code[lo:hi] - k] = 1
        common += m @ m.T
    size = np.array([len(s) for s in both], dtype=np.float64)
    common = common.astype(np.float64)
    ok = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    if right is None:
        return np.nonzero(np.triu(ok, 1))
    i, j = np.nonzero(ok[: len(left), len(left) :])
    return i, j + len(left)


def _stars(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, the smallest member it hangs together with) of those that aren't the smallest themselves."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            member = np.flatnonzero(label != np.arange(n))
            return member, label[member]


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, other, links): with other null a link count of rep (copies included), else an edge to the smallest rep that it hangs together with here.

    ``members``: (rep, b, partners, copies, shingles). A task per pair of blocks (i, j), to which each member goes once.
    """
    dealt = members.select("rep", "b", "copies", "shingles", F.explode("partners").alias("o")).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "copies", "shingles")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        rows = rows.assign(first=rows["b"] == i).sort_values(["first", "rep"], ascending=[False, True], ignore_index=True)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
        cut = int(rows["first"].sum())
        x, y = _linked(sets[:cut], sets[cut:] if j != i else None, threshold) if len(sets) > 1 and (j == i or 0 < cut < len(sets)) else (np.zeros(0, int),) * 2
        reps, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        links = np.bincount(x, copies[y], minlength=len(reps)) + np.bincount(y, copies[x], minlength=len(reps))
        has = np.flatnonzero(links)
        order = np.argsort(reps, kind="stable")  # labels by rep, so that the smallest rep is the root
        place = np.argsort(order)
        a, c = (order[e] for e in _stars(len(reps), place[x], place[y]))
        return pd.DataFrame(
            {"rep": np.concatenate([reps[has], reps[a]]), "other": pd.array([None] * len(has) + reps[c].tolist(), dtype="Int64"), "links": np.concatenate([links[has].astype(np.int64), np.zeros(len(a), np.int64)])}
        )

    return dealt.groupBy("i", "j").applyInPandas(run, "rep long, other long, links long")


def classes(docs: DataFrame, threshold: float = 0.8, trees: int = 32, depth: int = 8, recall: float = 0.999, block: int = 64, dense: int = 64) -> DataFrame:
    """doc_id, class_id (the smallest id of its class), n_links (documents at the threshold or above, copies included) of every document."""
    floor, n_floor = forest_shape(trees, depth, threshold, recall)
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a repeated doc_id is one document, the first text in text order; other texts are not shuffled for that while repeats are few
    repeated = materialize(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    known = known.join(repeated, "doc_id", "left_anti").unionByName(known.join(repeated, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    signed = materialize(signatures(known, trees, depth, floor), "signatures")
    one = signed.groupBy("doc_id").agg(F.min("set_key").alias("set_key"))
    reps = one.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    of_rep = signed.join(reps, (signed["doc_id"] == reps["rep"]) & (signed["set_key"] == reps["set_key"])).select("rep", "copies", "prefixes", "leaves").dropDuplicates(["rep"])
    member = materialize(forest(of_rep, trees, n_floor, dense), "members")
    placed = materialize(blocked(member.groupBy("rep").agg(F.first("home").alias("home"), F.min("bucket").alias("place")), block), "blocks")
    meeting = materialize(partners(member.select("rep", "bucket", "asks").join(placed, "rep")), "partners")
    full = meeting.join(sets_of(known, meeting.select("rep")), "rep").join(of_rep.select("rep", "copies"), "rep")
    found = materialize(verify(full, threshold), "verified")
    linked = components(found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("component", "class_id")
    counts = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    result = reps.join(linked, reps["rep"] == linked["id"], "left").drop("id").join(counts, "rep", "left")
    per_set = result.select("set_key", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    got = one.join(per_set, "set_key").select("doc_id", "class_id", "n_links")
    rest = known.select("doc_id").distinct().join(one, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return got.unionByName(rest)


def blocked(reps: DataFrame, block: int, slice_bits: int = 12) -> DataFrame:
    """(rep, b): ``reps`` (rep, home, place) in blocks of at most ``block`` of one home, neighbours in ``place`` order together.

    Members are ranked within slices of a home, cut by place and, for places that many share, by rep; the slices' totals
    then number them through, so that no home is sorted in one task.
    """
    half = slice_bits // 2
    top = lambda c, bits: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    cut = reps.withColumn("slice", (top("place", slice_bits - half) * (1 << half) + top("rep", half)).cast("int"))
    totals = cut.groupBy("home", "slice").agg(F.count("*").alias("n"))
    over = Window.partitionBy("home").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**slice_bits rows per home
    totals = totals.select("home", "slice", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    inside = cut.withColumn("at", F.row_number().over(Window.partitionBy("home", "slice").orderBy("place", "rep")) - 1)
    index = F.floor((F.col("before") + F.col("at")) / block)
    return inside.join(totals, ["home", "slice"]).select("rep", F.xxhash64("home", index).alias("b"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, the one of the smallest id; rows without doc_id stay."""
    drop = classes(docs, **options).where(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("_drop"))
    return docs.join(drop, docs["doc_id"] == drop["_drop"], "left_anti")
