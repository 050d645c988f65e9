"""Substring dedup, hard negatives and collocations against brute force, with the hard cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackspark.llm import collocations, hard_negatives, substring_dedup
from trackspark.llm.blocks import loosen, pack_words, squeeze, unpack_words
from test_operators import SCHEMA, hard_rows, lower, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passage(n, salt):
    return " ".join(f"{salt}{i * 31 % 101}" for i in range(n))


def repeat_rows():
    shared, other = passage(60, "s"), passage(55, "t")
    rows = [
        (3, f"intro three {shared} tail {other} end"), (2, f"{shared} only"), (5, f"{other} {shared} {shared}"), (9, passage(49, "u")), (8, passage(49, "u")),
        (10, passage(50, "v") + " x"), (11, "y " + passage(50, "v")), (12, None), (13, ""), (14, " \n "), (15, "w " * 200), (16, "w " * 120 + "z"), (7, passage(3000, "q")),
        (6, passage(3000, "q")), (20, f"{shared}"), (20, f"{shared} more"), (None, f"lone {shared}"), (None, f"lone {shared}"), (21, passage(25, "s") + " cut " + passage(25, "s")),
        (22, shared.upper()), (23, "x" * 50_000 + " " + other),
    ] + [(100 + i, f"start {i} {shared} {passage(30, 'abc'[i % 3])}") for i in range(40)]
    return [(doc, text, "en", "s", len(text or ""), "clash", 5) for doc, text in rows]


def brute_repeats(rows, width):
    words = [WORD.findall(r[1] or "") for r in rows]
    smallest = {}
    rank = lambda d: float("inf") if d is None else d
    for (doc, *_), own in zip(rows, words):
        for i in range(len(own) - width + 1):
            key = tuple(own[i : i + width])
            smallest[key] = min(smallest.get(key, float("inf")), rank(doc))
    out = []
    for (doc, *_), own in zip(rows, words):
        gone = set()
        for i in range(len(own) - width + 1):
            if smallest[tuple(own[i : i + width])] < rank(doc):
                gone.update(range(i, i + width))
        out.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return out


@pytest.mark.parametrize("width,chars", [(50, 8 << 20), (50, 300), (7, 2000), (2, 1)])
def test_repeats_equal_brute_force(spark, width, chars):
    rows = repeat_rows()
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), width, chars).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got], key=order) == sorted(brute_repeats(rows, width), key=order)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["repeats"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["repeats"], r["repeats"][1:]))  # maximal: no two touch


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def vectors():
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=11)], i % 3, "clash") for i in range(120)]
    rows += [(200, [0.0] * 11, 1, "zero"), (300, None, 1, "n"), (400, [float("nan")] * 11, 1, "n"), (500, [None] * 11, 1, "n"), (600, [1e30] * 11, 1, "n"), (None, [1.0] * 11, 1, "n")]
    rows += [(7, rows[7][1], 1, "same"), (10, rows[10][1], 1, "same again"), (20, rows[21][1], 0, "other vector"), (800, [1.0, 2.0], 1, "short"), (810, [], 0, "none")]
    rows += [(900 + i, rows[0][1], i % 2, "tie") for i in range(8)] + [(1000, rows[3][1], None, "no label"), (1100, [-3.0, 2.0], 7, "short")]
    return rows


def brute_negatives(rows, every, most, low=30, high=90):
    held = {
        (r[0], r[2], tuple(int(np.floor(256 * x)) for x in r[1]))
        for r in rows
        if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) and abs(256 * x) < 2**28 for x in r[1])
    }
    out = []
    for a in held:
        if a[0] % every:
            continue
        others = sorted([(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in held if b != a and len(b[2]) == len(a[2])])
        for p in [x for x in others if x[2] == a[1]][: most[0]]:
            fits = [n for n in others if n[2] != a[1] and low * -p[0] <= 100 * -n[0] <= high * -p[0]]
            out += [(a[0], p[1], i + 1, n[1], -p[0], -n[0]) for i, n in enumerate(fits[: most[1]])]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 7])
def test_negatives_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, q string")
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, 3, 4, block=block)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10, (3, 4)) != []
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(0, 2**20), st.integers(1, 30))
def test_subset_sums_give_inner_products(dim, size, n):
    draw = np.random.default_rng(size)
    q = draw.integers(-size - 1, size + 1, (n, dim))
    anchors = draw.integers(-size - 1, size + 1, (3, dim))
    assert (hard_negatives.scores(hard_negatives.bit_planes(q), hard_negatives.subset_sums(anchors)) == q @ anchors.T).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(2, 4), st.integers(0, 2**30), st.integers(0, 9))
def test_filters_lose_nothing(width, n, seed, bits):
    draw = np.random.default_rng(seed)
    grams = [draw.integers(0, 1 << width, 50).astype(np.uint64) for _ in range(n)]
    left, right, h = collocations.pack(grams, width)
    assert (collocations.unpack(left, right, h, n, width) == np.stack(grams, axis=1)).all()
    turned = collocations.permute(left, right, h)
    assert all((a == b).all() for a, b in zip(collocations.restore(*turned, h), (left, right)))
    left, right, counts, place = collocations.merged(*turned, h)
    want = Counter(zip(*[x.tolist() for x in turned]))
    assert dict(zip(zip(left.tolist(), right.tolist()), counts.tolist())) == want
    assert (left[place] == turned[0]).all() and (right[place] == turned[1]).all()
    bits = min(bits, h)
    part = left >> np.uint64(h - bits) if bits else np.zeros(len(left), np.uint64)
    for p in set(part.tolist()):
        own = part == p
        q, blob = collocations.write_filter(left[own], right[own], counts[own], h, bits)
        assert all((a == b[own]).all() for a, b in zip(collocations.read_filter(blob, q, p, h, bits), (left, right, counts)))


def test_packed_words_and_numbers_come_back():
    words = [b"", "é\nx".encode(), b"a" * 300]
    assert unpack_words(pack_words(words)) == words and unpack_words(pack_words([])) == []
    for kind in (np.uint8, np.uint32, np.int64):
        assert loosen(squeeze(np.array([], kind)), kind).tolist() == [] and loosen(squeeze(np.array([1, 200, 3], kind)), kind).tolist() == [1, 200, 3]


def phrase_rows():
    text = "New York City, the big big big City. in New York; of the\tday\nof the day! New York City"
    rows = [(i, text, ("en", None, "de")[i % 3]) for i in range(8)] + [(50, "und und und", "und"), (50, "und und und", "und"), (60, None, "en"), (61, "", "fr"), (62, " ,;. ", "xx")]
    rows += [(70, prose(4000, "n") + " " + prose(4000, "n"), "en"), (None, "x" * 30_000 + " New\x0bYork É é a\u00a0b a\u00a0b c\x1cd c\x1cd\u2003e", "en")]
    return [(doc, body, lang, "s", 1, "clash", 5) for doc, body, lang in rows]


def brute_phrases(rows, least, absorb, top, longest=4):
    total, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, held in f.items():
        cand = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        told = []
        for p, a in cand.items():
            if any(100 * b >= absorb * a for o, b in cand.items() if len(o) > len(p) and any(o[i : i + len(p)] == p for i in range(len(o) - len(p) + 1))):
                continue
            score, _, l, r = min((2_000_000 * a // (held[p[:k]] + held[p[k:]]), k, held[p[:k]], held[p[k:]]) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, phrase, l, r) in enumerate(sorted(told)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least,top,chars", [(2, 2000, 8 << 20), (3, 5, 1), (2, 7, 300)])
def test_phrases_equal_brute_force(spark, least, top, chars):
    rows = phrase_rows()
    got = collocations.mine(spark.createDataFrame(rows, SCHEMA), least, top=top, chars=chars)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, 80, top) != []


def test_phrases_of_an_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products_past_64_bits(spark):
    told = spark.sql(f"select cast({collocations.SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(a as decimal(20,0)) + cast(a + 1 as decimal(20,0))) as s from values (9000000000000000000L) t(a)")
    assert told.first()["s"] == 2_000_000 * 9 * 10**18 // (18 * 10**18 + 1)


def test_wide_word_numbers_take_the_long_way(spark, monkeypatch):
    """Words numbered past 16 bits make four-word keys of more than 64 bits; the result must not depend on it."""
    rows = hard_rows()
    want = sorted(map(tuple, collocations.mine(spark.createDataFrame(rows, SCHEMA), 2).collect()))
    real = collocations.pack
    assert want == brute_phrases(rows, 2, 80, 2000)
    left, right, h = real([np.array([2**31 + 5], np.uint64)] * 4, 32)
    assert h == 64 and collocations.unpack(left, right, h, 4, 32).tolist() == [[2**31 + 5] * 4]
