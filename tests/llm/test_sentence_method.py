"""The programme against all chains, what its terms decide, and what is learned."""

import math
import random

import duckdb
import pytest

from pairloom.llm import sentences as S


def all_spans(at, close, opens, inside, alone, usual, slope, open_end):
    """The same recurrence with every start kept."""
    n = len(at)
    total = [0.0] + [-math.inf] * (n - 1)
    for j in range(1, n):
        for i in range(j):
            size = math.log(at[j] - at[i])
            s = total[i] + opens[i] + close[j] - slope * (abs(size - usual) if not (open_end and j == n - 1) else max(0.0, size - usual))
            s += (S.UNBALANCED if inside[i] or inside[j] else 0) + (S.CARRIED if alone.get(j, -1) == i else 0)
            total[j] = max(total[j], s)
    return total[-1]


def test_starts_left_out_could_not_win():
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randint(2, 40)
        at = sorted(rng.sample(range(0, rng.choice([100, 400, 3000]) + n), n))
        close = [0.0, *(rng.uniform(-9, 9) * rng.choice([0.1, 1]) for _ in range(n - 2)), 0.0]
        opens = [0.0, *(rng.uniform(-4, 3) for _ in range(n - 2)), 0.0]
        inside = [False, *(rng.random() < 0.3 for _ in range(n - 2)), False]
        alone = {j: rng.randrange(j) for j in rng.sample(range(1, n), n // 4)}
        alone = dict({i: (j, i) for j, i in alone.items()}.values())  # a start waits for one place
        rest = alone, rng.choice([2.0, 3.5, 4.6]), rng.choice([0.3, 0.8, 3.0]), rng.random() < 0.5
        score, cuts = S.best_chain(at, close, opens, inside, *rest)
        assert score == pytest.approx(all_spans(at, close, opens, inside, *rest))
        chosen = [0, *cuts, n - 1]
        assert all(a < b for a, b in zip(chosen, chosen[1:]))


@pytest.fixture(scope="module")
def texts():
    return [x for (x,) in duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet' where text is not null order by doc_id").fetchall()]


@pytest.fixture(scope="module")
def lexicon(spark):
    words, lengths = S.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "text")
    return S.lexicon_of([tuple(r) for r in words.collect()], lengths)


def test_every_term_decides_some_units(texts, lexicon, monkeypatch):
    whole = [S.units(x, lexicon) for x in texts]

    def without(**values):
        with monkeypatch.context() as m:
            for k, v in values.items():
                m.setattr(S, k, v)
            return sum(S.units(x, lexicon) != u for x, u in zip(texts, whole))

    assert without(CAPITAL=0.0, SMALL=0.0, BRACKET=0.0) > 50  # opening words
    assert without(WORD=0.0, DOTTED=0.0, ABBREVIATION=0.0, MAYBE=0.0) > 1000  # closing words
    assert without(LENGTH_WEIGHT=0.0) >= 3
    assert without(UNBALANCED=0.0) > 1000 and without(CARRIED=0.0) > 200

    def one_by_one(at, close, opens, inside, *_):
        return 0.0, [k for k in range(1, len(at) - 1) if close[k] + opens[k] > 0 and not inside[k]]

    assert without(best_chain=one_by_one) > 200  # cutting wherever a place by itself looks right


def cut(text, lexicon):
    return [text[a:b] for a, b in S.units(text, lexicon)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    names = ["Orlinde", "Velmoor", "Tavash", "Hartuvin", "Quessary", "Murvane"]
    rows = []
    for k in range(400):
        a, b = rng.sample(names, 2)
        rows.append((k, f"The strand of {a} was seen by {b} in plate {k}? It was left by {a} and hgb. {b} in Grxx. {rng.choice(['one', 'two'])} it was zelv. the rest. They saw wing {rng.choice('ABCDEFG')} and wing {rng.choice('ABCDEFG')}, too. This was so! We left it."))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_abbreviations_and_labels_are_learned(corpus):
    words, lengths = S.learn(corpus, "text")
    lexicon = S.lexicon_of([tuple(r) for r in words.collect()], lengths)
    text = "It was seen by zelv. the strand. They saw wing B. The rest was left."
    assert cut(text, S.NOTHING) == ["It was seen by zelv.", "the strand.", "They saw wing B. The rest was left."]
    assert cut(text, lexicon) == ["It was seen by zelv. the strand.", "They saw wing B.", "The rest was left."]
    assert lexicon.opens["The"] > 1 > -1 > lexicon.opens["Velmoor"]
    assert lexicon.lengths["thai"] == S.LENGTHS["thai"] and lexicon.lengths["cased"] != S.LENGTHS["cased"]


def test_words_by_broadcast_and_by_join_give_the_same(spark, sf, corpus):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(corpus).unionByName(corpus.limit(5))
    docs = docs.unionByName(spark.createDataFrame([(None, "A zelv. the B. So"), (1, None), (2, "")], "doc_id long, text string"))
    got = [sorted(tuple(-1 if x is None else x for x in r) for r in S.sentences(docs, "doc_id", "text", broadcast_words=k).collect()) for k in (S.BROADCAST_WORDS, 0)]
    assert got[0] == got[1] and len(got[0]) > 2000
