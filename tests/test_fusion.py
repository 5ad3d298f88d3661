import random
from difflib import SequenceMatcher
from itertools import product

import pandas as pd
import pytest
from pyspark.sql import functions as F

from itemweave.operators import fusion


def test_near_matches_against_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randint(10, 60))) for _ in range(60)]

    def edit(t):
        t = list(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t))
            rng.choice([lambda: t.insert(i, "X"), lambda: t.pop(i), lambda: t.__setitem__(i, "Y")])()
        return "".join(t)

    new = [(f"n{i}", edit(rng.choice(base))) for i in range(80)] + [("short", "甲乙"), ("same", base[0])]
    old = [(f"o{i}", t) for i, t in enumerate(base)] + [("o00", base[0])]
    want = {}
    for i, t in new:
        if len(t) >= 12:
            scored = [(-SequenceMatcher(None, t, u).ratio(), o) for o, u in old if abs(len(t) - len(u)) <= max(8, len(t) * 0.2)]
            best = min(scored, default=(0, ""))
            if -best[0] >= 0.94:
                want[i] = (best[1], round(-best[0], 4))
    s = "id string, text string"
    got = {r.id: (r.similar_to, r.ratio) for r in fusion.near_matches(spark.createDataFrame(new, s), spark.createDataFrame(old, s)).collect()}
    assert got == want
    assert fusion.near_matches(spark.createDataFrame([], s), spark.createDataFrame(old, s)).count() == 0


def edited(rng, text, most):
    t = list(text)
    for _ in range(rng.randint(0, most)):
        i = rng.randrange(len(t))
        rng.choice([lambda: t.insert(i, "X"), lambda: t.pop(i), lambda: t.__setitem__(i, "Y"), lambda: t.insert(i, t.pop())])()
    return "".join(t)


def best_of_all(new, old):
    """{id: (similar_to, ratio)} by comparing every pair."""
    want = {}
    for i, t in new:
        near = [(o, SequenceMatcher(None, t, u)) for o, u in old if len(t) >= 12 and abs(len(t) - len(u)) <= max(8, len(t) * 0.2)]
        best = min(((-m.ratio(), o) for o, m in near if m.quick_ratio() >= 0.94), default=(0, ""))
        if -best[0] >= 0.94:
            want[i] = (best[1], pytest.approx(-best[0], abs=6e-5))
    return want


@pytest.mark.parametrize("shortest, longest, most", [(10, 40, 3), (30, 160, 9), (140, 420, 28)])
def test_near_matches_of_any_length(spark, shortest, longest, most):
    rng = random.Random(shortest)
    letters = [chr(0x4E00 + i) for i in range(3 * shortest)] + ["𠀀"]
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(shortest, longest))) for _ in range(40)]
    new, old = [(f"n{i}", edited(rng, base[i % 40], most)) for i in range(120)], [(f"o{i}", edited(rng, base[i % 40], 1)) for i in range(80)]
    s = "id string, text string"
    got = {r.id: (r.similar_to, r.ratio) for r in fusion.near_matches(spark.createDataFrame(new, s), spark.createDataFrame(old, s)).collect()}
    want = best_of_all(new, old)
    assert got == want and 40 < len(want)


def test_near_matches_compare_few_texts_of_one_template(spark, monkeypatch):
    rng, compared = random.Random(9), spark.sparkContext.accumulator(0)
    word = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(n))
    text = lambda: f"患者{word(3)}劳作后{word(3)}伴{word(2)}得温则缓脉{word(1)}其证候是"
    old = [(f"o{i}", text()) for i in range(400)]
    new = [(f"n{i}", text()) for i in range(380)] + [(f"m{i}", f"{old[i][1]}何") for i in range(20)]

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    monkeypatch.setattr(fusion, "match_ratio", counted)
    s = "id string, text string"
    got = {r.id: (r.similar_to, r.ratio) for r in fusion.near_matches(spark.createDataFrame(new, s), spark.createDataFrame(old, s)).collect()}
    assert got == best_of_all(new, old) and len(got) >= 20
    assert compared.value <= 100


def cost(observed, expected, mapping):
    matched = [m for m in mapping if m is not None]
    assert matched == sorted(matched)
    own = sum(1 if observed[m] is None else 0 if observed[m] == e else 2 for m, e in zip(mapping, expected) if m is not None)
    return own + 3 * (len(observed) + len(expected) - 2 * len(matched))


@pytest.mark.parametrize("observed", list(product([1, 2, 3, None], repeat=2)) + [(1, 3, 4), (), (2, None, 4, 4)])
def test_align_is_optimal(observed):
    expected = [1, 2, 3, 4]

    def best(i, j):
        if i == len(observed) or j == len(expected):
            return 3 * (len(observed) - i + len(expected) - j)
        own = 1 if observed[i] is None else 0 if observed[i] == expected[j] else 2
        return min(own + best(i + 1, j + 1), 3 + best(i + 1, j), 3 + best(i, j + 1))

    assert cost(list(observed), expected, fusion.align(list(observed), expected)) == best(0, 0)


def test_align_sequences(spark):
    seen = spark.createDataFrame([("p", 10, 1), ("p", 20, None), ("p", 30, 4)], "paper string, pos int, number int")
    want = spark.createDataFrame([("p", i, i) for i in (1, 2, 3, 4)] + [("q", 1, 1)], "paper string, ord int, number int")
    got = {(r.paper, r.number): r.pos for r in fusion.align_sequences(seen, want, ["paper"]).collect()}
    assert got[("p", 1)] == 10 and got[("p", 4)] == 30 and 20 in (got[("p", 2)], got[("p", 3)]) and got[("q", 1)] is None


def test_fuse(spark):
    df = spark.createDataFrame([("A", "A", None), ("A", "B", None), ("X", "B", None), (None, None, None), ("A", "B", "C")], "a string, b string, r string")
    assert [r[0] for r in df.select(fusion.fuse_letters(F.col("a"), F.col("b"), F.col("r"))).collect()] == ["A", None, "B", None, "C"]
    df = spark.createDataFrame([("a", "b"), (" ", "b"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(fusion.choose_text(F.col("a"), F.col("b"))).collect()] == ["a", "b", None]
