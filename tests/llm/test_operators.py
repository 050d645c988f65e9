"""Every operator against a brute-force version on a small table with the hard cases."""

import hashlib
import math
import re
from base64 import b32encode
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import bpe, language_id, line_dedup, minhash, mixing, quality_rules, queries, topk, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, th long"
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(n, salt):
    return " ".join(f"{salt}w{(i * 7919 + len(salt) * 31) % 997}" for i in range(n))


def hard_rows():
    base = prose(120, "a")
    words = base.split(" ")
    near = " ".join(words[:-1] + ["other"])
    shared = "A line that many documents share"
    rows = [
        (1, base, "en", "s0"), (2, base, "en", "s0"), (3, near, "en", "s1"), (4, None, "en", "s0"), (5, "", None, None),
        (6, f"first\n{shared}\n\nlast", "de", "s0"), (7, f"  {shared.upper()}\t\nother\nshort\nshort", "de", "s1"),
        (8, f"{shared}\n{shared}", "fr", "s0"), (9, "two words", "fr", "s0"), (10, "Two  Words", "fr", "s0"),
        (11, "x" * 40_000 + " " + prose(3000, "q"), "en", "s2"), (12, "  \n\t double  space <|endoftext|> é ü 😀", None, "s0"),
        (12, "  \n\t double  space <|endoftext|> é ü 😀", None, "s0"), (None, "nobody's text of some words", "en", "s0"),
    ] + [(20 + i, prose(60 + i, "abcdefgh"[i % 8]), ("en", "de")[i % 2], f"s{i % 3}") for i in range(12)]
    return [(*r, len(r[1] or ""), "clash", 5) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return hard_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup_equals_brute_force(docs, rows, empty):
    key = lambda line: lower(line.strip(SPACE))
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    want = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        first = lambda k: min(holders[k], key=lambda d: (d is None, d))
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) >= 2 and first(key(x)) != doc)]
        want.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert line_dedup.dedup_lines(empty).count() == 0


def brute_components(rows, width, percent):
    sets = {}
    for doc, text, *_ in rows:
        words = WORD.findall(lower(text or ""))
        span = min(width, len(words))
        sets[doc] = {tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set()
    sets.pop(None, None)
    part = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]) and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    return {d: (len(sets[d]), part[d], part[d] == d) for d in sets}


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    got = minhash.near_duplicates(docs).collect()
    named = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows) and named == brute_components(rows, 3, 85)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert minhash.near_duplicates(empty).count() == 0
    stay = sorted(r["doc_id"] for r in minhash.one_of_each(docs).collect() if r["doc_id"] is not None)
    assert stay == sorted(d for d, v in brute_components(rows, 5, 80).items() if v[2])


def test_every_coordinate_of_a_sketch_fills():
    one = minhash.sketch(minhash.shingle_hashes("just three words", 3), 130)
    assert len(one) == 130 and (one != 2**64 - 1).all()


def test_bpe_equals_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((str(doc if doc is not None else ""), ids, library.decode(ids, skip_special_tokens=False)))
    for chars in (1, 500, 8 << 20):  # a block a document, some, one a task
        got = bpe.decode(bpe.encode(docs, path, chars), path).select("doc", "ids", "decoded").collect()
        assert sorted((r[0], list(r[1]), r[2]) for r in got) == sorted(want)
    got = bpe.round_trip(docs, path, 500).select("doc", "ids", "decoded").collect()
    assert sorted((r[0], list(r[1]), r[2]) for r in got) == sorted(want)
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0


def test_warc_round_trip(spark):
    schema = "page_id long, url string, html string, digest string, file string"
    rows = [(3, "http://a/\r\nx", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (7, "é", "ü" * 50_000), (9, "u", "same"), (None, "u", "lone")]
    got = warc.round_trip(spark.createDataFrame([(*r, "x", "y") for r in rows], schema)).collect()
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        twins = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(twins, default=None)
        again = first is not None and page != first
        want.append((page, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0


def test_close_ranges_share_a_read():
    assert [(a, b) for a, b, _ in warc.ranges([(0, 10), (12, 5), (500, 5)], gap=10)] == [(0, 17), (500, 505)]


def test_mixing_spends_the_budget_and_takes_seeded_prefixes(spark, docs, empty):
    domain = F.when(F.char_length("text") >= 400, "prose").otherwise("notes")
    weights = {"prose": 3, "notes": 1, "prose/en": 5}
    picks = mixing.mix(docs, domain, weights, budget=2000, seed=3).collect()
    units = mixing._units(docs, domain).collect()
    budgets = {(r["domain"], r["lang"], r["source"]): r for r in mixing.leaf_budgets(mixing._units(docs, domain), weights, 2000, 1.0, 1).collect()}
    assert sum(r["allot"] for r in budgets.values()) == 2000
    assert all(0 <= r["allot"] <= r["have"] for r in budgets.values())
    taken = defaultdict(list)
    for r in picks:
        taken[(r["domain"], r["lang"], r["source"])].append((r["doc"], r["th"]))
    for leaf, budget in budgets.items():
        own = [u for u in units if (u["domain"], u["lang"], u["source"]) == leaf]
        whole = budget["allot"] == budget["have"]
        key = lambda u: (hashlib.md5(f"3|0|{'' if u['doc'] is None else u['doc']}".encode()).hexdigest(), u["th"])
        want, spent = [], 0
        for u in sorted(own, key=key):
            spent += u["tokens"]
            if whole or spent <= budget["allot"]:
                want.append((u["doc"], u["th"]))
        if budget["allot"]:
            assert sorted(map(str, taken[leaf])) == sorted(map(str, want))
        else:
            assert not taken[leaf]
    assert mixing.mix(empty, domain, weights).count() == 0


def test_mixing_moves_a_shortage_to_siblings_first(spark):
    rows = [(1, "w " * 10, "en", "a"), (2, "w " * 90, "en", "b"), (3, "w " * 100, "de", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    units = mixing._units(docs, F.lit("web"))
    got = {r["source"]: r["allot"] for r in mixing.leaf_budgets(units, {}, 100, 1.0, 1).collect()}
    assert got == {"a": 10, "b": 40, "c": 50}


def test_url_rules_and_vocabulary(spark):
    schema = "page_id long, url string, verdict string, j string"
    urls = {
        1: None, 2: "no scheme", 3: "http://WWW.Example.com/en/x?q", 4: "https://example.com/en/", 5: "https://a.b.net/fr/casino", 6: "ftp://x.org/casino?",
        7: "ftp://x.org/casinos", 8: "http://x.org/free-bonus", 9: "http://x.org/free-free", 10: "http://notexample.com#f", 11: "", 12: "http://x.org/" + "a/" * 9000 + "xxx",
    }
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame([(k, v, "v", "j") for k, v in urls.items()], schema), queries.RULES).collect()}
    assert {k: (r["rule"], r["verdict"]) for k, r in got.items()} == {
        1: (None, "allow"), 2: (None, "allow"), 3: ("www.example.com/en/", "allow"), 4: ("example.com/en/", "block"), 5: ("net/fr/", "block"), 6: (None, "block"),
        7: (None, "allow"), 8: (None, "block"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "block"),
    }
    assert (got[3]["host"], got[3]["path"], got[2]["host"]) == ("www.example.com", "/en/x", "")
    assert url_filter.judge_urls(spark.createDataFrame([], schema), queries.RULES).count() == 0


def test_top_k_equals_brute_force(spark):
    rows = [(i, [math.sin(i * j) * (1 + i % 7) for j in range(1, 9)]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(20)]
    rows += [(500, None), (550, [1.0, None] * 4), (600, [float("nan")] * 8), (650, [0.0] * 8), (700, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, q string, dim string"
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in usable:
        if i % 50 == 0:
            scored = sorted((-sum(map(lambda a, b: a * b, v, w)), j) for j, w in usable if j != i and len(w) == len(v))
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])]
    assert got == sorted(want)
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0


def test_quality_counts_equal_brute_force(docs, rows, empty):
    want = []
    for doc, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
        n = len(words)
        counts = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        want.append((doc, *counts, n < 50 or 100 * len(covered) > 50 * n))
    got = quality_rules.judge(docs).collect()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(str([r[c] for c in columns]) for r in got) == sorted(str(list(w)) for w in want)
    assert not any(r["kept"] for r in got if r["base_failed"]) and any(r["kept"] for r in got)
    assert quality_rules.judge(empty).count() == 0


def test_toxicity_on_held_out_rows(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels, queries.held_out(5, 0)).collect()} == {0.0}
    texts = [(i, prose(80, "abcdefgh"[i % 8]) + (" grobian" + "xyz"[i % 3] + " und schuft" if i % 4 == 0 else "") + f" end{i}") for i in range(240)]
    many = spark.createDataFrame([*texts, (None, "schuft"), (999, None), (998, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _ in texts] + [(1, 1, 0), (None, 0, 1)], labels.schema)
    told = toxicity.score_toxicity(many, marks, queries.held_out(5, 0)).collect()
    held = [r for r in told if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(told) == 243 and held
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in told) and {r["predicted"] for r in told if r["doc_id"] in (998, 999)} == {0}
    assert toxicity.score_toxicity(empty, labels, queries.held_out(5, 0)).count() == 0


def test_toxicity_learns_from_long_texts(spark):
    long = lambda i: prose(2600, "abcdefgh"[i % 8]) + f" end{i} "
    texts = [(i, long(i) + ("grobian und schuft " * 120 if i % 2 else "")) for i in range(40)]
    assert min(len(t) for _, t in texts) > toxicity.MOST_BYTES
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int")
    told = toxicity.score_toxicity(docs, labels, queries.held_out(5, 0)).collect()
    assert len(told) == 40 and sum(r["predicted"] == r["doc_id"] % 2 for r in told) >= 38


class BadWords:
    def all(self, found):
        return [9 * (w == "bad") for w in found]


def test_toxicity_limit_holds_in_a_small_group(monkeypatch):
    monkeypatch.setattr(toxicity, "GROUPS", 2)  # the four texts below would be a group each
    # 60 clean texts of a small kind hold three hits each, like the toxic texts of the large kind
    text = lambda words, bad: " ".join([words] * 48 + ["bad"] * bad)
    kinds = [(900, "aaaa bbbb", 0, 0), (300, "aaaa bbbb", 3, 1), (60, "xyxy zqzq", 3, 0), (20, "xyxy zqzq", 12, 1)]
    rows = [(text(words, bad), toxic) for n, words, bad, toxic in kinds for _ in range(n)]
    model = object.__new__(toxicity.Model)
    model.calibrate(
        np.array([toxicity.hits(t, BadWords()) for t, _ in rows]), np.array([toxicity.profile(t) for t, _ in rows]),
        np.array([float(y) for _, y in rows]),
    )
    assert [model.score(text(words, bad), BadWords()) >= 0.5 for _, words, bad, _ in kinds] == [False, True, False, True]


def test_language_on_held_out_rows(spark, empty):
    parts = {"en": "the and of that this with from ", "de": "der die und das nicht mit eine ", "fr": "le la les est dans pour une "}
    rows = [(i, " ".join((parts[lang].split() * 4)[i % 7 : i % 7 + 12]), lang) for i, lang in enumerate(list(parts) * 40)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !", None), (None, "und die", "de"), (902, "le la", None)], "doc_id long, text string, lang string")
    told = {r["doc_id"]: r for r in language_id.identify(df, queries.held_out(3, 1)).collect()}
    assert all(told[i]["lang_pred"] == lang for i, _, lang in rows)
    assert told[900]["lang_pred"] == told[901]["lang_pred"] == "und" and told[902]["lang_pred"] == "fr" and told[None]["held_out"] is None
    assert language_id.identify(empty, queries.held_out(3, 1)).count() == 0
