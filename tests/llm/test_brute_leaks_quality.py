"""Decontamination and the quality classifier against plain Python versions of their definitions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from splitline.llm import decontam, quality

from .helpers import corpus, docs_of, words
from .test_search_and_joins import QUESTION

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text, opened):
    """[(literal or placeholder, slot value or None, first word)] of one reading."""
    out, prev_name, start = [], False, True
    for i, w in enumerate(WORD.findall(text)):
        core = w.strip(decontam.STRIP)
        low = core.lower()
        capital = core.istitle() and core.isalpha()
        number = low in decontam.NUMBER_WORDS or bool(core[:1].isdigit() and decontam.NUMBER.match(core))
        kind = "<num>" if number else "<unit>" if low in decontam.UNITS else None
        name = kind is None and capital and (not start or (opened and low not in decontam.OPENERS))
        if name and prev_name and not start:
            out[-1][1].append(w)
        else:
            out.append(["<name>" if name else kind or low, [w], i, name or kind is not None])
        prev_name, start = name, w[-1] in ".!?:"
    return [(t, " ".join(ws).strip(decontam.STRIP).lower() if slot else None, i) for t, ws, i, slot in out]


def windows(toks, n):
    """{position: (key, slot values)} of the windows with no more placeholders than literals."""
    out = {}
    for p in range(len(toks) - n + 1):
        part = toks[p : p + n]
        slots = tuple(s for _, s, _ in part if s is not None)
        if len(slots) <= n // 2:
            out[p] = (tuple(t for t, _, _ in part), slots)
    return out


def readings(text, n, use_plain=True, use_open=True):
    """By reading: {position: {key: slots}}; the open one also has the plain windows that start at its words."""
    plain, opened = tokens(text, False), tokens(text, True)
    first = windows(plain, n) if use_plain else {}
    second = {p: dict([x]) for p, x in (windows(opened, n) if use_open else {}).items()}
    if use_open:
        place = {i: p for p, (_, _, i) in enumerate(opened)}
        for p, (k, s) in first.items():
            if plain[p][2] in place:
                second.setdefault(place[plain[p][2]], {}).setdefault(k, s)
    return [{p: {k: s} for p, (k, s) in first.items()}, second]


def exact(text, n):
    low = [w.strip(decontam.STRIP).lower() for w in WORD.findall(text)]
    return {p: {tuple(low[p : p + n]): ()} for p in range(len(low) - n + 1)}


def brute_leaks(docs, items, coverage=0.5):
    found = {}
    for item, text in items:
        sizes = [min(8, len(tokens(text, o))) for o in (False, True)]
        mine = {n: readings(text, n, n == sizes[0], n == sizes[1]) for n in set(sizes) if n}
        if not any(r for rs in mine.values() for r in rs):
            n = min(8, len(WORD.findall(text)))
            mine = {-n: [exact(text, n), {}]} if n else {}
        for doc, body in docs:
            best = None
            for reading in (0, 1):
                hits = defaultdict(lambda: [set(), set()])
                total = 0
                for n, rs in mine.items():
                    if not rs[reading]:
                        continue
                    total = len(rs[reading])
                    there = defaultdict(list)
                    for p, keys in (exact(body, -n) if n < 0 else readings(body, n)[reading]).items():
                        for k, s in keys.items():
                            there[k].append((p, s))
                    for p, keys in rs[reading].items():
                        for k, s in keys.items():
                            for q, t in there[k]:
                                hits[q - p][0].add(p)
                                hits[q - p][1].update(zip(s, t))
                for diagonal, (at, pairs) in hits.items():
                    if len(at) >= coverage * total and len(pairs) == len({a for a, _ in pairs}):
                        row = (len(at) / total, -reading, len(at), -diagonal, len({a for a, _ in pairs}), sum(a != b for a, b in pairs))
                        best = max(best or row, row)
            if best:
                found[doc, item] = (round(best[0], 9), best[2], best[4], best[5], best[5] > 0)
    return found


def found_by(spark, docs, items):
    got = decontam.leaks(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): (round(r.coverage, 9), r.n_windows, r.n_slots, r.n_changed, r.reparameterised) for r in got}


def test_leaks_against_brute_force(spark):
    items = [(1, QUESTION), (2, "Tom has 3 apples. Tom buys 4 more. How many apples does Tom have?"), (3, "Add 12 34 56 78"), (4, words(12, 4)), (5, "Mary Ann Lee walks 3 km. Then Bob walks 5 miles to the old mill."), (6, "one 2 three")]
    docs = [(i, t or "") for i, t in corpus() if i not in (None, 16)]
    for k, (_, t) in enumerate(items):
        docs += [(100 + k, f"before it. {t} and after"), (200 + k, t.replace("Tom", "Anna").replace("12", "40").replace("Maria", "Pedro Juan").replace("Bob", "Al")), (300 + k, t.replace("3", "9").replace("Tom", "Eve", 1))]
    want = brute_leaks(docs, items)
    assert len(want) > 8 and found_by(spark, docs, items) == want


def test_leaks_on_a_whole_table(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert found_by(spark, docs, items) == brute_leaks(docs, items)


def plain_features(text):
    """The features of the docstring, one word at a time."""
    ws = WORD.findall(text)
    out = set()
    for w in ws:
        core = w.strip(quality.STRIP.decode()).lower()
        if core:
            c = f"^{core}$"
            out |= {c} | {c[i : i + n] for n in (4, 5) for i in range(len(c) - n + 1)}
    bare = [w.strip(quality.STRIP.decode()) for w in ws]
    odd = sum(ord(w[-1]) < 128 and not w[-1].isalnum() and w[-1] not in ".,;:'\")?" and w != "|" for w in ws)
    counts = (odd, sum(w == "|" for w in ws), sum(len(b) > 1 and b.isupper() for b in bare), sum(a == b for a, b in zip(ws, ws[1:])))
    found = {zlib.crc32(x.encode()) & quality.MASK for x in out}
    return found | {zlib.crc32(b"~shape%d:%d" % (k, math.ceil(10 * c / max(1, len(ws))))) & quality.MASK for k, c in enumerate(counts)}


def test_quality_against_brute_force(spark):
    texts = [(i, f"good prose about topic {i} " + words(20, i)) for i in range(60)] + [(100 + i, f"BAD | junk ~ {i} junk junk " + words(20, 100 + i)) for i in range(40)] + [(200 + i, f"vile slur{i % 3} " + words(15, 200 + i)) for i in range(30)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(40)] + [(200 + i, 0, 1) for i in range(30)]
    docs = docs_of(spark, texts)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    grade = {d: 0 if t else 2 if q else 1 for d, q, t in labels}
    rated = sorted({(np.sort(np.array(list(plain_features(t)), dtype=np.uint32)).tobytes(), grade[d]) for d, t in texts})
    sets, g = [set(np.frombuffer(f, dtype=np.uint32).tolist()) for f, _ in rated], np.array([x for _, x in rated])
    n, df = len(sets), Counter(x for s in sets for x in s)
    p = {}
    for x, m in df.items():
        if m < 2:
            continue
        chi = 0.0
        for top in (0, 1):
            share = (g <= top).mean()
            spread = m * share * (1 - share) * (1 - m / n)
            hit = sum(x in s for s, y in zip(sets, g) if y <= top)
            chi = max(chi, (hit - m * share) ** 2 / max(spread, 1e-9) if spread > 0 else 0)
        p[x] = min(1.0, 2 * math.erfc(math.sqrt(chi / 2)))
    cut = max((q for k, q in enumerate(sorted(p.values()), 1) if q <= 0.001 * k / len(p)), default=-1)
    used = sorted(x for x, q in p.items() if q <= cut)
    assert set(np.flatnonzero(model.weights)) <= set(used) and len(used) > 5
    # the fit goes uphill to where the penalised likelihood is flat
    x = np.array([[u in s for u in used] for s in sets], dtype=float)

    def loss(w, t):
        s = x @ w
        low, high = 1 / (1 + np.exp(-(t[0] - s))), 1 / (1 + np.exp(-(t[1] - s)))
        return -np.log(np.select([g == 0, g == 1], [low, high - low], 1 - high).clip(1e-12)).sum() + 0.5 * w @ w

    w, t = model.weights[used].astype(float), np.array(model.thresholds)
    best = loss(w, t)
    r = np.random.default_rng(0)
    assert best < loss(w * 0, t) and all(loss(w + r.normal(0, 0.05, len(w)), t + r.normal(0, 0.05, 2)) > best - 0.02 * abs(best) for _ in range(200))
    for row in quality.score(docs, model).collect():
        s = sum(float(model.weights[f]) for f in plain_features(dict(texts)[row.doc_id]))
        ge1, ge2 = (1 / (1 + math.exp(th - s)) for th in model.thresholds)
        assert (row.score, row.expected_grade, row.tail_prob) == pytest.approx((s, ge1 + ge2, ge2), abs=1e-5) and row.keep == (row.tail_prob >= 0.5)


def test_words_hashed_together_have_the_same_shapes():
    words = [b"Plain", b"don't,", b"|", b"!!", b"ABC", b"x", b"(ab)", b"abc$", "Straße".encode(), "ÉTÉ".encode(), b"\xff\xfe", b"a" * 40, b"12-34;", b"end*"]
    used = bytes(i % 3 == 0 for i in range(1 << quality.BITS))
    known = quality.Shapes(used, limit=3)
    for _ in range(2):  # once anew, once from the old generation
        known.learn(words)
        for w in words:
            shape = quality._shape(w)
            got = known[w] or ((), False, False, False)
            assert set(got[0]) == {b for b in shape[0] if used[b]} and got[1:] == shape[1:]
        known.turn()
        assert not known and len(known.old) == len(words)
    owners, buckets = quality.piece_buckets([b"^ab$", b"^$", b"^abcdef$"])
    for i, w in enumerate((b"ab", b"", b"abcdef")):
        want = set(quality._shape(w)[0]) if w else {zlib.crc32(b"^$") & quality.MASK}
        assert set(buckets[owners == i].tolist()) == want
