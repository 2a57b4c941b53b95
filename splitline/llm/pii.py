"""Personal data by bootstrapped contextual extraction.

Base spans (email, ip, card, phone) come from fixed patterns and checks over
every whole text; they are the seeds. The words before a mention are its lexical
patterns ("l1": the word before it, "l2": the two words before it). Spark scores
the pattern-instance graph in rounds:

* a pattern's confidence for a kind is the score its distinct instances carry
  for that kind, over the distinct things that follow its words anywhere in the
  corpus (mentions, and the tokens of places where no mention starts), so that a
  context that ordinary words follow too never becomes confident, and copies of a
  passage or of an address count once;
* a pattern needs ``min_seeds`` distinct instances that are seeds or that reached
  ``accept`` for the kind in an earlier round, so that instances found in one
  round bring their own patterns into the next;
* an instance's score for a kind is 1 for a seed, else the noisy-or of the
  confident patterns (``min_confidence``) it occurs with.

Candidates are the whitespace-separated tokens of five characters or more that
hold a digit or '@', outer punctuation stripped, that overlap no base span; one
whose score reaches ``accept`` is added as a span of that kind. Base spans are
never removed.

Defined cases: a null text is empty and has no spans; repeated rows each report;
null doc_ids report with doc_id null; ties between kinds go to the earlier in the
list; very long texts, words and runs of digits, dots or address characters are scanned in
linear time; extra columns are ignored by :func:`find` and kept by :func:`redact`.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import bitmap
from .common import WordCache, fresh, materialize, mix

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"\S+")
STRIP = "!\"#$%&'()*,./:;<=>?[\\]^`{|}~"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each '@' with the address characters before it and a domain after it, left to right."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and text[left - 1] in LOCAL:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in CHAIN.finditer(text):
        parts = m.group().split(".") if "." in m.group() else ()
        at = m.start()
        for k in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[k : k + 4]
            end = at + len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x[-4:] if not x[:-4].strip("0") else "999" for x in four)):
                out.append(("ip", at, end))
            at = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _key(*words: str) -> int:
    if len(words) == 3 and words[0] == "l2":
        return int(_pair_keys(np.array([_key("l1", words[1])]), np.array([_key("l1", words[2])]))[0])
    h = xxhash.xxh64_intdigest("\0".join(words).encode())
    return h - (1 << 64) if h >> 63 else h


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of the patterns of two words, from the "l1" keys of the two."""
    with np.errstate(over="ignore"):
        return mix(first.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.int64).view(np.uint64)).view(np.int64)


def _name(word: str) -> str:
    """A word of a pattern: itself, or its hash where it is long, so that no pattern costs more than a line."""
    return word if len(word) <= 200 else f"\1{xxhash.xxh64_hexdigest(word)}"


def contexts(text: str, mentions: list[tuple[str | None, int, int]]) -> list[list[int]]:
    """Keys of the lexical patterns before each mention: the word, and the two words, before it.

    Before a mention that starts inside a word, what precedes it there since the last mention counts as a word. One pass
    over the words, whatever their number and length.
    """
    if not mentions:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    starts = [s for s, _ in spans]
    names: dict[int, str] = {}
    out: list[list[int]] = [[] for _ in mentions]
    free = 0
    for k in sorted(range(len(mentions)), key=lambda k: mentions[k][1:]):
        _, start, end = mentions[k]
        i = bisect.bisect_left(starts, start)  # the words before ``i`` start before the mention
        own = text[max(free, starts[i - 1]) : start].lower() if i and spans[i - 1][1] > start else ""
        i -= bool(i and spans[i - 1][1] > start)
        before = [_name(own)] if own else []
        for j in range(i - 1, max(-1, i - 3 + len(before)), -1):
            if j not in names:
                names[j] = _name(text[slice(*spans[j])].lower())
            before.append(names[j])
        keys = [_key("l1", w) for w in before]
        out[k] = keys[:1] + (_pair_keys(np.array(keys[1:]), np.array(keys[:1])).tolist() if len(keys) == 2 else [])
        free = max(free, end)
    return out


def mentions_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int]]:
    """(kind, start, end) of the base spans, then of the candidates, kind null."""
    out = list(spans)
    if "@" in text or DIGIT.search(text):
        covered: list[list[int]] = []  # what the base spans cover, as disjoint stretches in order
        for s, e in sorted((s, e) for _, s, e in spans):
            if covered and s < covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], e)
            else:
                covered.append([s, e])
        begins = [s for s, _ in covered]
        for m in re.finditer(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*", text) if len(text) < 4_000 else (m for m in TOKEN.finditer(text) if "@" in m.group() or DIGIT.search(m.group())):
            core = m.group().strip(STRIP)
            s = m.start() + m.group().find(core)
            e = s + len(core)
            near = bisect.bisect_left(begins, e)  # the last stretch that starts before the token's end
            if len(core) >= 5 and not (near and covered[near - 1][1] > s):
                out.append((None, s, e))
    return out


_MENTION = "struct<kind:string,start:int,end:int,instance:long,patterns:array<long>>"
_SCAN = f"row long, doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:string,start:int,end:int>>, mentions array<{_MENTION}>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base spans and all mentions (seeds with a kind, candidates with none)."""

    def run(batches):
        for b in batches:
            rows = []
            for row, doc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                text = text or ""
                spans = base_spans(text)
                found = mentions_of(text, spans)
                mentions = [{"kind": k, "start": s, "end": e, "instance": _key(text[s:e]), "patterns": p} for (k, s, e), p in zip(found, contexts(text, found))]
                n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                rows.append((row, doc, xxhash.xxh64_intdigest(text) - (1 << 63), *n, hashlib.sha256(joined(spans).encode()).hexdigest(), [{"kind": k, "start": s, "end": e} for k, s, e in spans], mentions))
            cols = list(zip(*rows)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCAN)


_SPAN = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
_TYPES = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.struct(_SPAN)), pa.list_(pa.struct([*_SPAN, ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))]
_NAMES = ["row", "doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"]


def _stretches(texts: list[str], size: int = 2_000_000):
    """Lists of texts of about ``size`` characters together."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def _followers(texts: list[str], bits: np.ndarray, gates: np.ndarray, key_of: WordCache, after: WordCache):
    """(pattern, follower) of every place of a pattern in ``bits`` where no mention starts. Words are coded once, and keys of their pairs are
    made together for the places whose word is a gate."""
    code: dict[str, int] = defaultdict(None)
    code.default_factory = code.__len__
    split = [t.lower().split() for t in texts]
    codes = np.concatenate([np.fromiter(map(code.__getitem__, w), np.int64, len(w)) for w in split])
    if not len(codes):
        return
    keys = np.array(key_of(list(code)), dtype=np.uint64).view(np.int64)
    inside = np.ones(len(codes), dtype=bool)  # all but the last word of each text have one behind them
    ends = np.cumsum([len(w) for w in split])
    inside[ends[ends > 0] - 1] = False
    first = np.zeros(len(codes), dtype=bool)
    first[[e for e, w in zip(ends - [len(w) for w in split], split) if w]] = True
    gate = np.flatnonzero(gates[bitmap.slots(keys)][codes] & inside)
    one = gate[bits[bitmap.slots(keys)][codes[gate]]]
    two = gate[~first[gate]]
    two_keys = _pair_keys(keys[codes[two - 1]], keys[codes[two]])
    held = bits[bitmap.slots(two_keys)]
    places = [*zip(one.tolist(), keys[codes[one]].tolist()), *zip(two[held].tolist(), two_keys[held].tolist())]
    starts: dict[int, list[bool]] = {}
    stops = ends.tolist()
    for i, key in places:
        d = bisect.bisect_right(stops, i)
        at = i - (stops[d] - len(split[d])) + 1
        w = split[d][at]
        if "@" in w or DIGIT.search(w):
            if d not in starts:  # the mentions of this text, as the scan has them
                mentioned = {s for _, s, _ in mentions_of(texts[d], base_spans(texts[d]))}
                starts[d] = [m.start() in mentioned for m in WORD.finditer(texts[d])]
            if starts[d][at]:
                continue
        yield key, after([w])[0]


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, others): how many distinct tokens follow each pattern's words in the whole corpus where no mention starts.

    ``patterns``: (pattern, gate), gate the "l1" key of the pattern's last word.
    """
    context = docs.sparkSession.sparkContext
    packed = [context.broadcast(np.packbits(bitmap.build(patterns, c)).tobytes()) for c in ("pattern", "gate")]

    def run(batches):
        bits, gates = (np.unpackbits(np.frombuffer(x.value, dtype=np.uint8)).view(bool) for x in packed)
        hashed = xxhash.xxh64_intdigest
        key_of = WordCache(lambda w: hashed("l1\0" + (w if len(w) <= 200 else _name(w))), 150_000)  # as in _key, without its sign
        after = WordCache(lambda w: _key(w.strip(STRIP) or w), 150_000)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            pairs: set[tuple[int, int]] = set()
            for some in _stretches(texts):
                pairs.update(_followers(some, bits, gates, key_of, after))
            found = np.array(list(pairs), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["pattern", "follower"])

    pairs = docs.select("text").mapInArrow(run, "pattern long, follower long").distinct()
    return pairs.join(patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("others"))


def score_graph(docs: DataFrame, edges: DataFrame, rounds: int, min_seeds: int, min_confidence: float, accept: float) -> DataFrame:
    """(instance, kind, score) of the non-seed instances. ``edges``: distinct (instance, pattern, gate, seed), seed null for candidates.

    A round reads the texts only for patterns that were not counted before and
    that reach ``min_confidence`` over their mentions alone.
    """
    seeds = edges.where(F.col("seed").isNotNull()).select("instance", "pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    others = edges.where(F.col("seed").isNull()).select("instance", "pattern")
    mentions = edges.groupBy("pattern", "gate").agg(F.count_distinct("instance").alias("n_mentions"), F.count_if(F.col("seed").isNull()).alias("n_open")).where("n_open > 0").drop("n_open")
    scored, counted, found = seeds, None, None
    for _ in range(rounds):
        able = (
            scored.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= accept).alias("n_support"))
            .where(F.col("n_support") >= min_seeds)
            .join(mentions, "pattern")
            .where(F.col("mass") / F.col("n_mentions") >= min_confidence)
        )
        able = materialize(able, "pii-able")
        fresh = able.select("pattern", "gate").distinct()
        if counted is not None:
            fresh = fresh.join(asked, "pattern", "left_anti")
        fresh = materialize(fresh, "pii-patterns")
        if counted is None or not fresh.isEmpty():
            more = materialize(occurrences(docs, fresh), "pii-places")
            counted, asked = (more, fresh) if counted is None else (counted.unionByName(more), asked.unionByName(fresh))
        conf = (
            able.join(counted, "pattern", "left")
            .select("pattern", "kind", F.least(F.lit(0.999), F.col("mass") / (F.col("n_mentions") + F.coalesce("others", F.lit(0)))).alias("confidence"))
            .where(F.col("confidence") >= min_confidence)
        )
        found = others.join(conf, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        found = materialize(found, "pii-found")
        scored = seeds.unionByName(others.join(found, "instance").select("instance", "pattern", "kind", "score"))
    return found


def extract(docs: DataFrame, rounds: int = 2, min_seeds: int = 5, min_confidence: float = 0.6, accept: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(the scanned documents, the (row, more) spans that confident patterns add)."""
    scanned = materialize(scan(docs), "pii-scan")
    mention = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    # the first pattern, "l1", is the gate of both
    edges = mention.select("instance", F.explode("patterns").alias("pattern"), F.col("patterns")[0].alias("gate"), F.col("kind").alias("seed")).distinct()
    score = score_graph(docs, materialize(edges, "pii-edges"), rounds, min_seeds, min_confidence, accept)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = score.where(F.col("score") >= accept).groupBy("instance").agg(F.min_by("kind", F.struct(F.negative("score"), order)).alias("found"))
    # one document's mentions are bounded by its own length
    added = mention.where("kind is null").join(best, "instance").groupBy("row").agg(F.collect_list(F.struct(F.col("found").alias("kind"), "start", "end")).alias("more"))
    return scanned, added


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (text) and span_list (all spans) of every document."""
    scanned, added = extract(docs, **options)
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
    spans = F.transform(
        F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))), lambda s: F.struct(place(s).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["s"].alias("start"), s["e"].alias("end")),
    )
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.join(added, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), spans.alias("span_list"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of its text replaced by ``<kind>``; other columns stay. Overlapping spans become one, named by the first.

    Base spans are found again from the text; only the added ones come by a join, on the document and its text.
    """
    scanned, added = extract(docs, **options)
    more = scanned.select("row", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).join(added, "row").groupBy("_doc", "_key").agg(F.first("more").alias("_more"))

    @F.arrow_udf("long")
    def key_of(text: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh64_intdigest(t or "") - (1 << 63) for t in text.to_pylist()], pa.int64())

    @F.arrow_udf("string")
    def run(text: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, extra in zip(text.to_pylist(), found.to_pylist()):
            spans = base_spans(t or "") + [(x["kind"], x["start"], x["end"]) for x in extra or ()]
            parts, at = [], 0
            for kind, s, e in sorted(spans, key=lambda s: (s[1], -s[2])):
                if s >= at:
                    parts += [t[at:s], f"<{kind}>"]
                at = max(at, e)
            out.append("".join(parts) + t[at:] if spans else t)
        return pa.array(out, pa.string())

    own = docs.columns
    key, doc, other, extra = (fresh(own, name) for name in ("text_key", "found_doc", "found_key", "found_more"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in own], key_of("text").alias(key))
    found = more.toDF(doc, other, extra)
    got = keyed.join(found, keyed["doc_id"].cast("long").eqNullSafe(found[doc]) & (keyed[key] == found[other]), "left")
    return got.select(*[run("text", extra).alias("text") if c == "text" else F.col(f"`{c}`") for c in own])
