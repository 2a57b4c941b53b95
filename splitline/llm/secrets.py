"""Secrets in texts: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Base spans (assign, access, hex) come from fixed patterns over every whole text.
They are never removed. The method adds spans of kind ``random``:

1. Candidates are runs of 16 characters or more of ``[A-Za-z0-9+/_-]`` (with up to
   two ``=`` behind them) that overlap no base span. Each one's encoding is
   inferred as the smallest alphabet that holds it: hex, base32, base36 (one case),
   base62, base64, base64url; digits alone, and mixtures of the last two, have none.
2. A battery of three tests against random draws from that alphabet: chi-squared
   uniformity of the symbols (upper tail, Wilson-Hilferty), runs above and below
   the alphabet's middle, and lag-1 serial correlation. The largest of the three
   deviations, in standard errors, is the candidate's distance from randomness.
3. How random does ordinary text of that length look? Every document's text
   outside base spans and candidates is cut into decoys: strings of its characters
   that belong to an alphabet (letters folded to one case where the alphabet has
   one), of the shortest length of one of the length bands; the band goes by the
   text's hash. Decoys go through the same battery. A candidate's p-value is the
   share of its alphabet's and band's decoys that are as close to randomness as it
   is, so that short strings, on which the tests have no power, are never
   significant.
4. Benjamini-Hochberg over the distinct candidates at rate ``rate``: those that
   pass are secrets.

Texts are read once. What is gathered from the corpus is a histogram per alphabet,
band and step of the distance (``CELLS`` cells, whatever the input); candidates
stay with their documents.

Defined cases: a null text is empty and has no spans; repeated rows, and null
doc_ids, each report; where there are no decoys or too few of them, no p-value is
small and nothing is added; very long texts and runs are scanned in linear time;
extra columns are ignored; an empty table gives no rows. Offsets are code points,
end exclusive; spans are ordered by start, then kind (assign, access, hex, random).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialize, text_bytes

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
_MIXED = re.compile(rb"[+/_-]")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A text without any of these, in lower case, has no assignment.
WORDS = (b"passw", b"secret", b"token", b"key")

_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
#: Alphabets in their encodings' order; ``folded`` ones take letters of either case.
ALPHABETS = {
    "hex": _DIGITS + b"abcdef", "base32": _LOWER + b"234567", "base36": _DIGITS + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + b"+/", "base64url": _UPPER + _LOWER + _DIGITS + b"-_",
}
FOLDED = ("hex", "base32", "base36")
#: Shortest lengths of the length bands.
BANDS = (16, 20, 24, 32, 40, 64, 128)
#: Steps of the distance: quarters of a standard error, the last for 8 and more.
STEPS = 33
#: Bytes of text whose decoys are cut at a time, so that their sums stay in a core's cache, and of a slice of a longer text. Running sums are of 32
#: bits; they may wrap, their differences over a decoy don't.
SLAB, SLICE = 1 << 17, 1 << 20
CELLS = len(ALPHABETS) * len(BANDS) * STEPS


def _codes(name: str) -> np.ndarray:
    """Code of each byte in the alphabet, 255 for none."""
    out = np.full(256, 255, dtype=np.uint8)
    for i, c in enumerate(ALPHABETS[name]):
        out[c] = i
        if name in FOLDED:
            out[ord(chr(c).upper())] = i
    return out


CODES = {name: _codes(name) for name in ALPHABETS}
_LETTERS = frozenset(_UPPER + _LOWER)


def encoding_of(run: bytes) -> str | None:
    """The smallest alphabet that holds a run without its padding; None for digits alone and for mixed specials."""
    symbols = set(run)
    plus, minus = symbols & set(b"+/"), symbols & set(b"-_")
    if not symbols & _LETTERS or plus and minus:
        return None
    if plus or minus:
        return "base64" if plus else "base64url"
    if symbols & set(_UPPER) and symbols & set(_LOWER):
        return "base62"
    if not {c | 32 if c in _LETTERS else c for c in symbols} - set(ALPHABETS["hex"]):
        return "hex"
    return "base32" if not symbols - set(_UPPER + b"234567") else "base36"


def distances(codes: np.ndarray, size: int) -> np.ndarray:
    """The battery's largest deviation for each row of equally long strings over an alphabet of ``size`` symbols, at most 8."""
    n, length = codes.shape
    c = codes.astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * size + codes).ravel(), minlength=n * size).reshape(n, size)
    high = codes >= size // 2
    ends = c[:, 0] + c[:, -1]
    sums = (counts**2).sum(axis=1), high.sum(axis=1), (high[:, 1:] != high[:, :-1]).sum(axis=1), c.sum(axis=1), (c * c).sum(axis=1), (c[:, 1:] * c[:, :-1]).sum(axis=1), ends
    return _battery(*sums, size, length)


def _battery(alike, high, changes, total, squares, products, ends, size: int, length: int) -> np.ndarray:
    """The largest deviation from whole sums of each string's codes: squared symbol counts, codes above the middle, changes across it, codes, their
    squares, products of neighbours, and the first and last code together."""
    chi = alike.astype(np.float64) * size / length - length
    scale, freedom = (length - 1) / length, (size - 1) * length / (length - 1)  # its exact mean and variance on short strings
    spread = 2 / (9 * freedom)
    uniform = (np.cbrt(chi / (scale * freedom)) - (1 - spread)) / np.sqrt(spread)

    above = high.astype(np.float64)
    pairs = 2 * above * (length - above)
    variance = pairs * (pairs - length) / (length**2 * (length - 1.0))
    alternation = np.where(variance > 0, np.abs(changes - pairs / length) / np.sqrt(np.where(variance > 0, variance, 1)), 8.0)

    square = length * (length * squares - total**2)  # times length squared, and so are the centred products
    serial = (length * length * products - length * total * (2 * total - ends) + (length - 1) * total**2) / np.where(square > 0, square, 1)
    correlation = np.where(square > 0, np.abs(serial + 1 / length) * np.sqrt(length), 8.0)
    return np.clip(np.maximum(np.maximum(uniform, alternation), correlation), 0, 8)


def cells(codes: np.ndarray, name: str, band: int) -> np.ndarray:
    """Cell of each row: its alphabet, band and step of the distance."""
    return _cell(distances(codes, len(ALPHABETS[name])), name, band)


def _cell(distance: np.ndarray, name: str, band: int) -> np.ndarray:
    steps = np.minimum(distance * 4, STEPS - 1).astype(np.int64)
    return (list(ALPHABETS).index(name) * len(BANDS) + band) * STEPS + steps


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start, then kind."""
    low = text.lower()  # of bytes: only A-Z, and no offset moves
    out = []
    if any(w in low for w in WORDS):
        out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters that overlap no base span, left to right."""
    out, taken, at = [], sorted((s, e) for _, s, e in spans), 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at == len(taken) or taken[at][0] >= e:  # by start, so all later ones begin further on
            out.append((s, e))
    return out


def _decoys(texts: list[bytes]) -> np.ndarray:
    """The histogram of the decoys of every band that ordinary texts give. Texts are taken SLAB bytes at a time, those over SLICE bytes in slices."""
    found = np.zeros(CELLS, dtype=np.int64)
    slab, size = [], 0
    for text in texts:
        for at in range(0, len(text), SLICE):
            slab.append(text[at : at + SLICE])
            size += len(slab[-1])
            if size >= SLAB:
                found += _slab_decoys(slab)
                slab, size = [], 0
    return found + _slab_decoys(slab) if slab else found


def _slab_decoys(texts: list[bytes]) -> np.ndarray:
    """Texts without any of ``+/_-`` have the same symbols in base62, base64 and base64url, and in the last two the same decoys."""
    plain, mixed = [], []
    for t in texts:
        (mixed if _MIXED.search(t) else plain).append(t)
    return sum((_cut(t, t is plain) for t in (plain, mixed) if t), np.zeros(CELLS, dtype=np.int64))


def _cut(texts: list[bytes], plain: bool) -> np.ndarray:
    """Each text is cut anew for each band. Sums over a decoy are differences of running sums, which all bands share; symbol counts of a band whose
    length is twice another's are sums of two of its. ``plain``: :func:`_slab_decoys`."""
    found = np.zeros(CELLS, dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    last = np.cumsum([len(t) for t in texts])
    per_alphabet = len(BANDS) * STEPS
    shared: dict[int, np.ndarray] = {}  # of a length: base62's squared symbol counts
    for place, name in enumerate(ALPHABETS):
        if plain and name == "base64url":
            found[place * per_alphabet : (place + 1) * per_alphabet] += found[(place - 1) * per_alphabet : place * per_alphabet]
            continue
        codes = CODES[name][data]
        inside = codes < 255
        upto = np.concatenate([[0], np.cumsum(inside)[last - 1]])
        first, per, size = upto[:-1], np.diff(upto), len(ALPHABETS[name])
        c = codes[inside].astype(np.int32)
        if not len(c):
            continue
        high = c >= size // 2
        running = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)]).astype(np.int32)
        p_high, p_change, p_code, p_square, p_product = running(high), running(high[1:] != high[:-1]), running(c), running(c * c), running(c[1:] * c[:-1])
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of a length: each text's first decoy, and the decoys' symbol counts
        for band, length in enumerate(BANDS):
            own = per // length
            at = np.concatenate([[0], np.cumsum(own)])
            n = int(at[-1])
            if not n:
                continue
            rank = np.arange(n) - np.repeat(at[:-1], own)
            start = np.repeat(first, own) + rank * length
            if plain and name == "base64":
                alike = shared[length]
            else:
                if length % 2 == 0 and length // 2 in counts:
                    half_at, half = counts[length // 2]
                    pair = np.repeat(half_at[:-1], own) + 2 * rank
                    symbols = half[pair] + half[pair + 1]
                else:
                    rows = c[start[:, None] + np.arange(length)] + np.arange(n)[:, None] * size
                    symbols = np.bincount(rows.ravel(), minlength=n * size).reshape(n, size).astype(np.int16)
                counts[length] = at, symbols
                alike = np.einsum("ij,ij->i", symbols, symbols, dtype=np.int32)
                if plain and name == "base62":
                    shared[length] = alike
            end, of = start + length, lambda p, start=start: (p[start + length] - p[start]).astype(np.int64)  # noqa: B023
            inner = lambda p: (p[end - 1] - p[start]).astype(np.int64)  # noqa: B023,E731
            sums = alike, of(p_high), inner(p_change), of(p_code), of(p_square), inner(p_product), (c[start] + c[end - 1]).astype(np.int64)
            found += np.bincount(_cell(_battery(*sums, size, length), name, band), minlength=CELLS)
    return found


def _places(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets as code points."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(before[s]), int(before[e])) for s, e in spans]


_SPAN = "array<struct<kind:string,start:int,end:int>>"
_SCAN = f"cell int, n long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base {_SPAN}, tokens array<struct<start:int,end:int,key:long,cell:int>>"
_STRUCTS = [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("key", pa.int64()), ("cell", pa.int32())]))]
_TYPES = [pa.int32(), *[pa.int64()] * 5, pa.string(), *_STRUCTS]
_NAMES = ["cell", "n", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens"]


def _tokens(text: bytes, runs: list[tuple[int, int]], places: list[tuple[int, int]]) -> list[dict]:
    """The runs that have an encoding, with their text's hash and cell."""
    out = []
    for (s, e), (start, end) in zip(runs, places):
        bare = text[s:e].rstrip(b"=")
        name = encoding_of(bare)
        if name:
            band = sum(len(bare) >= b for b in BANDS) - 1
            code = CODES[name][np.frombuffer(bare, dtype=np.uint8)][None, :]
            out.append({"start": start, "end": end, "key": xxhash.xxh64_intdigest(bare) - (1 << 63), "cell": int(cells(code, name, band)[0])})
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """A row per document (base spans, candidates), cell null; and rows (cell, n) that count decoys."""

    def run(batches):
        for b in batches:
            rows, ordinary = [], []
            for doc, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                spans = base_spans(text)
                runs = candidates(text, spans)
                places = _places(text, [(s, e) for _, s, e in spans] + runs)
                base = [(k, *p) for (k, _, _), p in zip(spans, places)]
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((None, None, doc, *n, digest, [{"kind": k, "start": s, "end": e} for k, s, e in base], _tokens(text, runs, places[len(base) :])))
                at, parts = 0, []
                for s, e in sorted([(s, e) for _, s, e in spans] + runs):
                    parts.append(text[at:s])
                    at = max(at, e)
                ordinary.append(b"".join([*parts, text[at:]]) if parts else text)
            histogram = _decoys(ordinary)
            rows += [(int(c), int(histogram[c]), None, None, None, None, None, None, None) for c in np.flatnonzero(histogram)]
            cols = list(zip(*rows)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCAN)


def accepted(decoys: dict[int, int], tokens: dict[int, int], rate: float) -> list[int]:
    """Cells whose candidates are secrets: Benjamini-Hochberg over the distinct candidates, p-values from the decoys of the same alphabet and band."""
    d, t = (np.array([x.get(c, 0) for c in range(CELLS)], dtype=np.float64).reshape(-1, STEPS) for x in (decoys, tokens))
    p = ((1 + np.cumsum(d, axis=1)) / (1 + d.sum(axis=1, keepdims=True))).ravel()
    t = t.ravel()
    order = np.argsort(p, kind="stable")
    upto = np.cumsum(t[order])[np.searchsorted(p[order], p[order], side="right") - 1]  # equal p-values stand or fall together
    passing = (t[order] > 0) & (p[order] * t.sum() <= rate * upto)
    return [] if not passing.any() else np.flatnonzero((p <= p[order][passing].max()) & (t > 0)).tolist()


def find(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans (text), n_random and span_list (all spans) of every document."""
    scanned = materialize(scan(docs), "secrets")
    decoys = scanned.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n"))
    kept = scanned.where("cell IS NULL").drop("cell", "n")
    distinct = kept.select(F.explode("tokens").alias("t")).select("t.key", "t.cell").distinct().groupBy("cell").agg(F.count("*").alias("n"))
    count = lambda df: {r["cell"]: r["n"] for r in df.collect()}  # noqa: E731  at most CELLS rows
    good = F.array(*map(F.lit, accepted(count(decoys), count(distinct), rate))).cast("array<int>")
    more = F.transform(F.filter("tokens", lambda t: F.array_contains(good, t["cell"])), lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
    ordered = F.array_sort(F.transform(F.concat("base", more), lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.when(F.size("tokens") == 0, F.col("base")).otherwise(F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    found = kept.withColumn("span_list", spans)
    text = F.array_join(F.transform("span_list", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size(F.filter("span_list", lambda s: s["kind"] == "random")).cast("long").alias("n_random"), "span_list")
