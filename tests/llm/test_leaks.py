"""Leaked passages against plain comparison of word runs."""

import math
import random
import unicodedata

import numpy as np
import pytest

from pairloom.llm import leaks as module
from pairloom.llm import problems
from pairloom.llm.leaks import CODE, NAME, NUMBER, UNIT, consistent, leaks, patterns, placeholder, prepare, roll, words


def test_words():
    assert words("Ａb-9 naïve_x 2.5 Å") == ["ab", "9", "naïve", "x", "2", "5", "å"]
    assert words("残基abcループ") == ["残", "基", "abc", "ル", "ー", "プ"]
    assert words("ที่ค่า pH") == [*"ที่ค่า", "ph"] and words("हिन्दी क्षेत्र") == ["हिन्दी", "क्षेत्र"]
    assert words("") == [] and words("…!") == []


def test_placeholders():
    common = frozenset({"the"})
    assert [placeholder(w, common) for w in ("the", "12", "8t0oj0", "å", "crixin", "残")] == ["the", NUMBER, CODE, UNIT, NAME, "残"]


def test_roll():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 50).astype(np.uint64)
    values = np.r_[values, values]
    for k in (1, 2, 3, 5, 12, 30, 50):
        h = roll(values, k)
        assert len(h) == 101 - k and h[0] == h[50] and len(set(h[:50].tolist())) == 50
    assert len(roll(values[:3], 4)) == 0


def brute(docs, items):
    runs = []
    for item, lang, text in items:
        if item is None or not text:
            continue
        k = 30 if (lang or "") in ("zh", "ja") else 12
        ws = words(text)
        runs.append((item, k, {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}))
    out = set()
    for doc, text in docs:
        if doc is None or not text:
            continue
        ws = words(text)
        for item, k, own in runs:
            if any(tuple(ws[i : i + k]) in own for i in range(len(ws) - k + 1)):
                out.add((doc, item))
    return out


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, lang string, text string, doc_id string")
    got = leaks(d.select("doc_id", "text", "item_id"), i, **more)
    assert got.columns == ["doc_id", "item_id"]
    return {tuple(r) for r in got.collect()}


def texts(rng, n, alphabet):
    return [" ".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]


def test_p6_against_brute_force(spark):
    rng = random.Random(6)
    alphabet = [*"abcdefgh", "12", "7", "x9", "nm", "漢"]
    items = [(i, rng.choice(["en", "zh", "ja", None]), t) for i, t in enumerate(texts(rng, 40, alphabet))]
    docs = []
    for d, t in enumerate(texts(rng, 150, alphabet)):
        if rng.random() < 0.5:
            ws = words(rng.choice(items)[2])
            at, k = rng.randint(0, max(0, len(ws) - 1)), rng.choice([11, 12, 13, 29, 30, 40])
            t += " … " + ", ".join(w.upper() for w in ws[at : at + k]) + "! " + rng.choice(alphabet)
        docs.append((d, t))
    want = brute(docs, items)
    assert found(spark, docs, items) == want and len(want) > 20


def test_p6_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, "en", t) for i, t in enumerate(texts(rng, 12, list("abcdefghijk")))]
    docs = [(d, items[d % 12][2]) for d in range(24)]
    whole = found(spark, docs, items)
    monkeypatch.setattr(module, "BLOCK_ITEMS", 5)
    assert found(spark, docs, items) == whole == brute(docs, items)


def test_p6_edges(spark):
    run = "a b c d e f g h i j k l"
    assert found(spark, [(1, run), (1, run), (None, run), (2, None), (3, ""), (4, run.upper().replace(" ", "—"))], [(9, "en", run), (9, "en", run), (None, "en", run), (8, "en", None), (7, "zh", run), (6, "en", "short")]) == {(1, 9), (4, 9)}
    assert found(spark, [], [(9, "en", run)]) == set() and found(spark, [(1, run)], []) == set()
    assert found(spark, [(1, "z " * 200_000 + run)], [(9, "en", run)]) == {(1, 9)}
    assert found(spark, [(1, unicodedata.normalize("NFD", "é " * 12))], [(9, "en", "é " * 12)]) == {(1, 9)}


def test_p6_renamed(spark):
    base = "near residue {} the chain of {} binds {} at {} when {} is closed"
    items = [(i, "en", base.format(10 + i, f"n{'abc'[i]}rin", f"mo{'abc'[i]}lin", 3, f"mo{'abc'[i]}lin")) for i in range(3)]
    same = base.format(99, "zorin", "qualin", 4, "qualin")
    mixed = base.format(99, "zorin", "qualin", 4, "other")
    docs = [(1, same), (2, mixed), (3, items[0][2]), (4, "nothing")]  # the items have 15 words
    got = found(spark, docs, items, renamed=True, window=15)
    assert {d for d, _ in got} == {1, 3} and (3, 0) not in got and (3, 1) in got
    assert consistent(["a", "b", "a"], ["x", "y", "x"]) and not consistent(["a", "b"], ["x", "x"]) and not consistent(["a", "a"], ["x", "y"])


def test_prepare_lengths():
    p = prepare([(1, "zh", "漢" * 40), (2, "en", "a " * 20), (3, "en", "b")], 12, 30)
    assert set(p.windows) == {12, 30} and len(p.windows[30][0]) == 11 and len(p.windows[12][0]) == 9


def test_patterns_are_renamings():
    rng = random.Random(3)
    for _ in range(400):
        k = rng.randint(1, 8)
        a, b = ([rng.choice("abcde") for _ in range(k + 3)] for _ in range(2))
        plain = [np.array([hash(x) & (2**63 - 1) for x in ws], np.uint64) for ws in (a, b)]
        at = np.arange(4)
        same = patterns(plain[0], at, k) == patterns(plain[1], at, k)
        assert same.tolist() == [consistent(a[i : i + k], b[i : i + k]) for i in at]


def brute_renamed(docs, items):
    """(doc, item) by the docstring of ``leaks``."""
    seen = {}
    for _, _, t in items:
        for w in set(words(t)):
            seen[w] = seen.get(w, 0) + 1
    common = frozenset(w for w, n in seen.items() if n >= min(module.COMMON, len(items)))
    cut = [(d, ws, [placeholder(w, common) for w in ws]) for d, t in docs for ws in [words(t)]]
    held = {}
    for _, ws, ts in cut:
        for k in (12, 30):
            for w in {tuple(ts[i : i + k]) for i in range(len(ts) - k + 1)}:
                held[w] = held.get(w, 0) + 1
    out = set()
    for item, lang, text in items:
        k = 30 if lang in ("zh", "ja") else 12
        iw = words(text)
        it = [placeholder(w, common) for w in iw]
        for d, ws, ts in cut:
            fits = {}
            for i in range(len(ws) - k + 1):
                for j in range(len(iw) - k + 1):
                    if ts[i : i + k] == it[j : j + k] and consistent(ws[i : i + k], iw[j : j + k]):
                        fits[i, j] = tuple(ts[i : i + k]), ws[i : i + k] == iw[j : j + k]
            for i, j in fits:
                if (i - 1, j - 1) in fits:
                    continue
                n = 0
                while (i + n, j + n) in fits:
                    n += 1
                run = [fits[i + x, j + x] for x in range(n)]
                side_by_side = [held[t] for t, _ in run[::k]]
                chance = len(docs) * math.prod(x / len(docs) for x in side_by_side)
                rare = n > k and chance <= module.CHANCE * (1 + 1e-9) or n + k - 1 == len(iw) and len(side_by_side) == 1 and side_by_side[0] <= module.RARE
                if 2 * sum(copied for _, copied in run) < n and rare:
                    out.add((d, item))
    return out


def test_p6_renamed_against_brute_force_with_few_and_many_items(spark, monkeypatch):
    rng = random.Random(8)
    alphabet = [*"abcdef", "12", "7", "x9", "nm", "漢", "zorin", "mopin", "qualin"]
    items = [(i, rng.choice(["en", "zh", None]), t) for i, t in enumerate(texts(rng, 60, alphabet)) if t]
    docs = []
    for d in range(120):
        ws = words(rng.choice(items)[2])
        to = rng.choice([{"12": "31", "7": "8", "x9": "y8"}, {"12": "5", "7": "5"}, {"12": "7", "7": "12"}, {}])
        docs.append((d, " ".join(rng.choices(alphabet, k=3)) + " " + " ".join(to.get(w, w) for w in ws)))
    want = brute_renamed(docs, items)
    assert found(spark, docs, items, renamed=True) == want and len(want) > 10
    monkeypatch.setattr(module, "BLOCK_ITEMS", 5)
    assert found(spark, docs, items, renamed=True) == want
    assert found(spark, docs, items) == brute(docs, items)


def test_p6_many_items_give_the_same_on_whole_tables(spark, sf, monkeypatch):
    few = [sorted(map(tuple, getattr(problems, name)(spark, sf).collect())) for name in ("p6_found", "p6_renamed")]
    for block in (5, 50):
        monkeypatch.setattr(module, "BLOCK_ITEMS", block)
        assert [sorted(map(tuple, getattr(problems, name)(spark, sf).collect())) for name in ("p6_found", "p6_renamed")] == few
    docs = [(r["doc_id"], r["text"]) for r in problems.table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["lang"], r["text"]) for r in problems.table(spark, sf, "eval_items").collect()]
    assert set(few[0]) == brute(docs, items)


def test_p6_renamed_finds_planted_items(spark):
    """Items with other numbers and names, planted whole or in part: recall and precision."""
    rng = random.Random(9)
    spark_items = spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet").collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"]]
    items = [(r["item_id"], r["lang"], r["text"]) for r in spark_items]
    common = prepare(items, 12, 30).common
    planted, changed = set(), []
    for d, (item, lang, text) in enumerate(rng.sample(items, 120), 10_000_000):
        ws = words(text)
        to = {}
        for w in ws:
            kind = placeholder(w, common)
            if w not in to:
                to[w] = str(rng.randint(1000, 9999)) if kind == NUMBER else f"{rng.randint(2, 9)}{''.join(rng.choices('bcdfghjklmnp', k=5))}{rng.randint(0, 9)}" if kind == CODE else "".join(rng.choices("bcdfghjklmnp", k=9)) if kind == NAME else w
        new = [to[w] for w in ws]
        if new == ws:
            continue
        size = max(26 if lang not in ("zh", "ja") else 62, len(new) // 2) if rng.random() < 0.5 else len(new)
        changed.append((d, "qu " * rng.randint(0, 40) + " ".join(new[:size]) + " qu" * rng.randint(0, 40)))
        planted.add((d, item))
    got = found(spark, [*docs, *changed], items, renamed=True)
    true = {p for p in got if p in planted}
    others = {p for p in got if p[0] >= 10_000_000} - planted
    assert len(planted) > 80 and len(true) / len(planted) >= 0.9, (len(true), len(planted))
    assert len(true) / (len(true) + len(others)) >= 0.9, (len(true), len(others))
