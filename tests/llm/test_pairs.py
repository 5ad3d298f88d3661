"""p7: HyperMinHash, banding, estimates, and the pairs against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from itemweave.llm import kernel as K
from itemweave.llm import near_dups


def strip(x):
    import unicodedata

    return "".join(c for c in (x or "").lower() if unicodedata.category(c)[0] in "LN")


def grams(row):
    out = set()
    for t in (row["stem"], row["explanation"], *(row["options"] or {}).values()):
        t = strip(t)
        out |= {t[i : i + 3] for i in range(len(t) - 2)}
    return out


def item(row):
    return strip(row["stem"]), tuple(sorted(strip(v) for v in (row["options"] or {}).values()))


def bank(seed, sentence, n=60):
    rng, rows = random.Random(seed), []
    for i in range(n):
        base = {"stem": sentence((seed, i), 20), "explanation": sentence((seed, i, 1), 60), "options": {k: sentence((seed, i, k), 6) for k in "ABCDE"}}
        for c in range(rng.choice([1, 1, 2, 3])):
            row = {k: dict(v) if isinstance(v, dict) else v for k, v in base.items()}
            for _ in range(rng.randint(0, 4) if c else 0):
                t = list(row["explanation"])
                t[rng.randrange(len(t))] = rng.choice("甲乙丙丁")
                row["explanation"] = "".join(t)
            if c and rng.random() < 0.5:
                row["options"]["A"] = "改" + row["options"]["A"]
            rows.append(row | {"id": f"q{len(rows):04d}"})
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(items, sentence, seed):
    rows = bank(seed, sentence)
    rows += [{"id": "null1", "stem": None, "options": None, "explanation": None}, {"id": "null2", "stem": None, "options": None, "explanation": None}]
    sets = [grams(r) for r in rows]
    want = set()
    for i in range(len(rows)):
        for j in range(i):
            union = sets[i] | sets[j]
            if union and item(rows[i]) != item(rows[j]) and len(sets[i] & sets[j]) >= 0.6 * len(union):
                want.add((rows[j]["id"], rows[i]["id"]))
    q = items(*rows, extra={"content": "int", "item": "int", "n": "int", "band": "int"})
    assert {tuple(r) for r in near_dups.near_duplicates(q).collect()} == want and want
    groups = {r.id: r.group_id for r in near_dups.near_duplicate_groups(q).collect()}
    assert len(groups) == len(rows) and all(groups[a] == groups[b] for a, b in want)


def test_records_without_runs_have_no_partner_and_no_group(items, sentence):
    short = [{"id": f"s{i}", "stem": x, "options": {}, "explanation": None} for i, x in enumerate(("ab", "cd", "ef", "", None, "甲、乙"))]
    rows = [*short, short[0], {"id": "t1", "stem": sentence(1, 30), "options": {}, "explanation": None}, {"id": "t2", "stem": sentence(1, 30)[:-1] + "甲", "options": {}, "explanation": None}]
    q = items(*rows)
    assert {tuple(r) for r in near_dups.near_duplicates(q).collect()} == {("t1", "t2")}
    groups = [tuple(r) for r in near_dups.near_duplicate_groups(q).collect()]
    assert sorted(groups) == sorted([(r["id"], r["id"], 0) for r in [*short, short[0]]] + [("t1", "t1", 1), ("t2", "t1", 1)])


@pytest.mark.parametrize(("cap", "hot", "sample"), [(2, 10**9, 64), (1024, 3, 1), (3, 4, 1)])
def test_large_and_hot_buckets_lose_nothing(items, sentence, monkeypatch, cap, hot, sample):
    """Items from one template that meet in most bands, beside near ones: the exact prefix filter takes over."""
    monkeypatch.setattr(near_dups, "BUCKET_CAP", cap)
    monkeypatch.setattr(near_dups, "HOT_BAND", hot)
    monkeypatch.setattr(near_dups, "SAMPLE", sample)
    template = sentence("t", 60)
    rows = [{"id": f"q{i:03d}", "stem": template[:30] + sentence((i // 2, "s"), 14) + ("又" if i % 2 else ""), "options": {"A": f"甲{i}"}, "explanation": template[30:] + sentence((i // 2, "e"), 14)} for i in range(60)]
    sets = [grams(r) for r in rows]
    want = {(rows[j]["id"], rows[i]["id"]) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert {tuple(r) for r in near_dups.near_duplicates(items(*rows)).collect()} == want and len(want) >= 30


def test_prefix_pairs_against_all_pairs(spark, sentence):
    rows, rng = [], random.Random(3)
    for i in range(40):
        base = sentence((i // 4, "p"), 40)
        rows.append((i, [base[: rng.randint(20, 40)] + sentence((i, "q"), rng.randint(3, 12)), sentence("same", 10)]))
    sets = [grams({"stem": p[0], "explanation": p[1], "options": {}}) for _, p in rows]
    want = {(j, i) for i in range(40) for j in range(i) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    got = {tuple(r) for r in near_dups.prefix_pairs(spark.createDataFrame(rows, "content long, parts array<string>")).collect()}
    assert want and want <= got


def test_equal_contents_of_different_items(items, sentence):
    s = sentence(1, 30)
    rows = [{"id": f"c{i}", "stem": s, "options": {"A": "x"}, "explanation": None} for i in range(3)] + [{"id": "d", "stem": s, "options": {"A": "y"}, "explanation": None}]
    assert {tuple(r) for r in near_dups.near_duplicates(items(*rows)).collect()} == {("c0", "d"), ("c1", "d"), ("c2", "d")}


def test_awkward_rows_and_empty_tables(odd_bank):
    assert near_dups.near_duplicates(odd_bank).collect() == []
    assert {r.id for r in near_dups.near_duplicate_groups(odd_bank).collect()} == {"n1", "e1", "v1", "r1", "o1"}
    assert near_dups.near_duplicates(odd_bank.limit(0)).count() == 0 == near_dups.near_duplicate_groups(odd_bank.limit(0)).count()


def test_registers_agree_with_the_probability_of_jaccard():
    rng = np.random.default_rng(0)
    n, errors = 400, []
    for shared in (20, 100, 180):
        base = rng.integers(0, 2**62, (n, 200)).astype(np.uint64)
        other = base.copy()
        other[:, shared:] = rng.integers(0, 2**62, (n, 200 - shared))
        own = np.repeat(np.arange(n), 200)
        a, b = (K.hyperminhash(x.ravel(), own, n, 4, 6, 10) for x in (base, other))
        errors.append(abs((a == b).mean() - shared / (400 - shared)))
    assert max(errors) < 0.02


def test_estimate_corrects_collisions():
    rng = np.random.default_rng(1)
    n = 500
    own = np.repeat(np.arange(n), 150)
    a, b = (K.hyperminhash(rng.integers(0, 2**62, n * 150).astype(np.uint64), own, n, 1, 6, near_dups.SKETCH_MANTISSA) for _ in range(2))
    assert near_dups.estimate(a, b).mean() < 0.03


def pairs_of(rows, cap, monkeypatch, size):
    monkeypatch.setattr(near_dups, "BUCKET_CAP", cap)
    table = pa.table({"band": pa.array([r[0] for r in rows], pa.int64()), "content": pa.array([r[1] for r in rows], pa.int64())})
    small, large = set(), {}
    for b in near_dups.paired(iter(table.to_batches(max_chunksize=size))):
        for band, x, y in zip(*(b.column(c).to_pylist() for c in ("band", "a", "b"))):
            if y is None:
                large.setdefault(band, set()).add(x)
            else:
                small.add((x, y))
    return small | {(x, y) for m in large.values() for x in m for y in m if x < y}


@pytest.mark.parametrize("cap", [2, 5, 100])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_paired_loses_nothing_at_batch_and_bucket_edges(monkeypatch, cap, size):
    rng = random.Random(cap * 1000 + size)
    rows = sorted((rng.randint(0, 12), rng.randint(0, 40)) for _ in range(150))
    want = {(x, y) for b, x in rows for c, y in rows if b == c and x < y}
    assert pairs_of(rows, cap, monkeypatch, size) == want


def test_distinct_grams_match_sets(sentence):
    texts = [sentence(i, 30) for i in range(20)] + ["", "ab", "İstanbul ǅ"]
    gram, owner = K.trigrams(texts, np.arange(len(texts)))
    _, off = K.distinct(gram, owner, len(texts))
    want = [len({strip(t)[i : i + 3] for i in range(len(strip(t)) - 2)}) for t in texts]
    assert np.diff(off)[:-1].tolist() == want[:-1]


@pytest.mark.parametrize("size", [1, 50, 10**6])
def test_bounded_parts_keep_every_row(monkeypatch, size):
    monkeypatch.setattr(K, "BYTES", size)
    texts = ["", None, "甲" * 40, "乙", "b" * 70, None, "c"]
    lists = [["a", "bb"], [], None, ["甲" * 30], ["x"] * 9, [None], ["y"]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.string()))], ["t", "l"])
    for column in ("t", "l"):
        parts = list(K.bounded(iter([batch, batch.slice(2, 4)]), column, 3))
        assert [v for p in parts for v in p.column("t").to_pylist()] == texts + texts[2:6]
        assert max(p.num_rows for p in parts) <= 3


def test_a_hot_item_with_two_contents(items, sentence):
    """Half of all records are one item, under two explanations that are near each other, and one edited item."""
    s, e = sentence(1, 40), sentence(2, 80)
    rows = [{"id": f"h{i:03d}", "stem": s, "options": {"A": "x"}, "explanation": e + ("又" * (i % 2))} for i in range(60)]
    rows += [{"id": "edit", "stem": s + "甲", "options": {"A": "x"}, "explanation": e}]
    rows += [{"id": f"o{i}", "stem": sentence((i, 5), 40), "options": {"A": "x"}, "explanation": sentence((i, 6), 80)} for i in range(60)]
    got = {tuple(r) for r in near_dups.near_duplicates(items(*rows)).collect()}
    assert got == {("edit", f"h{i:03d}") for i in range(60)}


def test_no_table_grows_with_the_chance_meetings_of_a_template(spark, items, sentence, monkeypatch):
    """200 unrelated items of one template meet in thousands of buckets, most of them large; no step writes those meetings or all runs."""
    written, sizes = near_dups.written, {}

    def counted(df, name, **more):
        out = written(df, name, **more)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dups, "written", counted)
    monkeypatch.setattr(near_dups, "BUCKET_CAP", 4)
    template = sentence("t", 50)
    rows = [{"id": f"q{i:03d}", "stem": template[:25] + sentence((i, "s"), 25), "options": {"A": f"甲{i}"}, "explanation": template[25:] + sentence((i, "e"), 25)} for i in range(200)]
    rows.append(rows[0] | {"id": "edit", "stem": rows[0]["stem"] + "又"})
    sets = [grams(r) for r in rows]
    alike = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(200) for j in range(i)]
    assert 0.3 < min(alike) and max(alike) < 0.45
    assert {tuple(r) for r in near_dups.near_duplicates(items(*rows)).collect()} == {("edit", "q000")}
    assert max(sizes.values()) <= 2 * len(rows), sizes
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("cap", [2, 70, 1024])
def test_bucket_pairs_against_all_pairs(monkeypatch, cap):
    """Small and large buckets, copies, and contents that differ in about a fifth or a half of their marks."""
    monkeypatch.setattr(near_dups, "BUCKET_CAP", cap)
    rng = np.random.default_rng(cap)
    base = rng.integers(0, 2**63, (7, near_dups.MARKS // 64)).astype(np.uint64)
    entries = np.empty(400, near_dups.ENTRY)
    entries["content"] = rng.integers(-150, 150, 400)
    flips = lambda: np.bitwise_and.reduce(rng.integers(0, 2**63, (3, base.shape[1])).astype(np.uint64))
    marks = {c: base[c % 7] ^ flips() for c in range(-150, 150)}
    entries["marks"] = [marks[c] for c in entries["content"].tolist()]
    entries["band"] = np.where(np.arange(400) < 250, 5, rng.integers(6, 60, 400))
    differing = lambda a, b: sum(bin(int(x)).count("1") for x in marks[a] ^ marks[b])
    places = set(zip(entries["band"].tolist(), entries["content"].tolist()))
    limit = {c: int(rng.integers(60, 90)) for c in range(-150, 150)}
    entries["limit"] = [limit[c] for c in entries["content"].tolist()]
    want = {(x, a, b) for x, a in places for y, b in places if x == y and a < b and differing(a, b) <= max(limit[a], limit[b])}
    got = [(a, b) for pair in near_dups._bucket_pairs(entries) for a, b in zip(*(x.tolist() for x in pair))]
    assert len(got) == len(want) > 500 and set(got) == {w[1:] for w in want}


def test_texts_that_travel_in_several_rounds(items, sentence, monkeypatch):
    rows = bank(3, sentence, 30)
    q = items(*rows)
    once = sorted(tuple(r) for r in near_dups.near_duplicates(q).collect())
    monkeypatch.setattr(near_dups, "VERIFIED", 3)
    assert sorted(tuple(r) for r in near_dups.near_duplicates(q).collect()) == once and len(once) > 10


def test_marks_of_short_texts_lose_no_pair():
    """Pairs with a similarity of exactly 0.6, of 20 runs each, whose registers are mostly empty, and of 160 runs."""
    rng = np.random.default_rng(5)
    for runs, n in ((20, 2000), (160, 2000)):
        base = rng.integers(0, 2**62, (n, runs)).astype(np.uint64)
        other = base.copy()
        other[:, : runs // 4] = rng.integers(0, 2**62, (n, runs // 4)).astype(np.uint64)
        own = np.repeat(np.arange(n), runs)
        a, b = (K.hyperminhash(x.ravel(), own, n, near_dups.SEEDS, near_dups.BITS, near_dups.MANTISSA) for x in (base, other))
        differing = np.bitwise_count(near_dups._marks(a) ^ near_dups._marks(b)).sum(axis=1, dtype=np.int64)
        limit = np.maximum(near_dups._limits(a), near_dups._limits(b))
        assert (differing > limit).sum() <= 4
        assert near_dups._limits(a).mean() < (130 if runs == 20 else 107)
