"""p8 to p10 over documents: brute force, reached shares, round trips."""

import random
import unicodedata

import numpy as np
import pytest

from itemweave.llm import contamination, mixing, splitting
from itemweave.llm.tokens import encoding, token_ends, vocabulary

DOC = "doc_id long, text string, source string, text_ string, key string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, None, None) for i, t, s in rows], DOC)


# ---- p8


def strip(x):
    return "".join(c for c in x.lower() if unicodedata.category(c)[0] in "LN")


def test_leaks_against_brute_force(spark, sentence):
    rng = random.Random(8)
    items = [(i, sentence(("item", i), rng.choice([39, 60, 120]))) for i in range(12)] + [(90, None), (91, ""), (92, "短")]
    rows = []
    for d in range(80):
        text = sentence(("doc", d), 200)
        if d % 4 == 0:
            _, t = items[rng.randrange(12)]
            n, at = rng.choice([30, 39, 40, 45]), rng.randrange(5)
            piece = t[at : at + n]
            piece = "，".join(piece[i : i + 7] for i in range(0, len(piece), 7)) if d % 8 == 0 else piece
            text = text[:50] + piece + text[50:]
        rows.append((d, text, "s"))
    rows += [(100, None, None), (101, "", "s"), (0, rows[0][1], "s")]
    want = set()
    for d, t, _ in rows:
        for i, x in items:
            a, b = strip(t or ""), strip(x or "")
            if any(b[k : k + 40] in a for k in range(len(b) - 39)):
                want.add((d, i))
    ev = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in contamination.leaks(docs(spark, rows), ev).collect()}
    assert got == want and want
    counts = {r.item_id: r.documents for r in contamination.leaked_items(docs(spark, rows), ev).collect()}
    assert sum(counts.values()) == len(want)


def test_leaks_in_blocks_and_empty(spark, sentence, monkeypatch):
    items = [(i, sentence(i, 60)) for i in range(6)]
    ev = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, [(i, "前" + t + "后", "s") for i, t in items])
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 100)
    assert {tuple(r) for r in contamination.leaks(d, ev).collect()} == {(i, i) for i, _ in items}
    assert contamination.leaks(d.limit(0), ev).count() == 0 == contamination.leaks(d, ev.limit(0)).count()


def test_every_window_has_a_prefix(sentence):
    items = contamination.Items([1, 2], [sentence(1, 90), sentence(2, 45)])
    chosen = set(items.at[items.prefixes(items.hash.view("int64"), np.arange(len(items.hash)) % 5)].tolist())
    w = contamination.RUN - contamination.SHINGLE + 1
    for start, end in zip(items.off[:-1], items.off[1:]):
        for at in range(start, end - contamination.RUN + 1):
            assert any(at <= p < at + w for p in chosen)
    assert len(chosen) < len(items.at)


# ---- p9


def test_mixture_reaches_its_shares(spark, sentence):
    rng = random.Random(9)
    rows, n = [], 0
    for s, count in (("a", 600), ("b", 900), ("c", 300), ("off", 200), (None, 50)):
        for _ in range(count):
            rows.append((n, sentence(n, rng.randint(10, 60)), s))
            n += 1
    d = docs(spark, rows + [(n, None, "a"), (n + 1, "", "a")])
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.2, 4), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    rep = {r.source: r for r in mixing.report(d, t).collect()}
    assert set(rep) == {"a", "b", "c", "off", "absent"} and rep["off"].tokens == 0
    assert all(abs(rep[s].reached_share - rep[s].target_share) < 0.02 for s in "abc") and abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-9
    assert max(rep[s].repeats / rep[s].max_repeats for s in "abc") == pytest.approx(1)
    used = mixing.mixed(d, t).collect()
    per = {}
    for r in used:
        per[r.doc_id] = per.get(r.doc_id, 0) + 1
    most = {"a": 3, "b": 1, "c": 4}
    source = {i: s for i, _, s in rows}
    assert all(per[i] <= most[source[i]] for i in per) and {(r.doc_id, r.copy) for r in used} == {(r.doc_id, r.copy) for r in mixing.mixed(d, t).collect()}
    for i, k in per.items():
        assert int(rep[source[i]].repeats) <= k <= int(rep[source[i]].repeats) + 1
    assert sum(r.tokens for r in used) == sum(r.tokens for r in rep.values())


def test_mixture_holds_whole_documents(spark, sentence):
    rows = [(7, "甲的文本。", "a"), (7, "另一文本。\n第二行", "a"), (8, "b" * 20_000, "a")]
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    used = mixing.mixed(docs(spark, rows), t).collect()
    assert sorted((r.doc_id, r.text, r.source, r.copy) for r in used) == sorted((*r, k) for r in rows for k in (1, 2))


def test_mixture_of_nothing(spark):
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    d = docs(spark, [(1, None, None)])
    assert mixing.mixed(d, t).count() == 0 and [tuple(r)[:4] for r in mixing.report(d, t).collect()] == [("a", 1.0, 0.0, 0)]
    assert mixing.mixed(d.limit(0), t).count() == 0 == mixing.mixed(d, t.limit(0)).count()


# ---- p10


@pytest.fixture(scope="module")
def enc():
    return encoding(vocabulary())


@pytest.mark.parametrize("kind", ["sentences", "lines", "no marks", "latin", "emoji", "mixed"])
def test_split_round_trip(enc, sentence, kind):
    text = {
        "sentences": "".join(sentence(i) for i in range(120)), "lines": "\n\n".join(sentence(i)[:-1] for i in range(100)), "no marks": "".join(sentence(i)[:-1] for i in range(120)),
        "latin": "The spleen delays congestion of the throat. " * 150, "emoji": "😀👩‍🔬𠀀" * 300, "mixed": "甲" * 900 + "。\n" + "word " * 800 + "乙，" * 500,
    }[kind]
    limit, overlap = 256, 32
    pieces = splitting.split(enc, text, limit, overlap)
    assert len(pieces) > 1 and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    ends = token_ends(enc, text)
    back = text[pieces[0][0] : pieces[0][1]]
    for (a, b, _), (c, d, n) in zip(pieces, pieces[1:]):
        assert a < c < b < d
        back += text[b:d]
        held = sum(1 for e in ends if c < e <= b)
        assert held <= overlap + 3 and len(enc.encode_ordinary(text[c:b])) <= 3 * overlap
        assert n <= limit
    assert back == text and pieces[0][2] <= limit
    assert all(len(enc.encode_ordinary(text[a:b])) == n for a, b, n in pieces)
    if kind in ("sentences", "latin"):
        assert all(text[:b].rstrip()[-1] in "。." for _, b, _ in pieces)
    if kind == "lines":
        assert all("\n" in text[b - 1 : b + 1] for _, b, _ in pieces[:-1])


def brute(sizes_ok, cost, at, limit, overlap, mean, n):
    best = {0: (0.0, [])}
    for j in at:
        options = [(best[i][0] + splitting.IMBALANCE * ((j - i + (overlap if i else 0)) / mean - 1) ** 2, best[i][1]) for i in best if i < j and j - i + (overlap if i else 0) <= limit]
        if options:
            v, path = min(options, key=lambda x: x[0])
            best[j] = (v + (cost[j] if j < n else 0), [*path, j])
    return best[n]


@pytest.mark.parametrize(("levels", "excess"), [(3, 1e-9), (6, 1.0)])
def test_cuts_against_the_program_over_all_positions(levels, excess):
    """Exact where all boundaries are strong; with weak ones among them within a small part of the cheapest weak cut's 6."""
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randint(60, 150)
        ends = np.arange(1, n + 1)
        cost = np.array([rng.choice(splitting.PENALTIES[:levels]) for _ in range(n + 1)])
        limit, overlap = 30, 5
        got = splitting.cuts(ends, cost, limit, overlap)
        pieces = max(1, -(-(n - overlap) // (limit - overlap)))
        mean = (n - overlap) / pieces + overlap
        at = [j for j in range(overlap + 1, n + 1)]
        want, _ = brute(None, cost, at, limit, overlap, mean, n)
        total, i = 0.0, 0
        for j in got:
            size = j - i + (overlap if i else 0)
            assert size <= limit
            total += splitting.IMBALANCE * (size / mean - 1) ** 2 + (cost[j] if j < n else 0)
            i = j
        assert got[-1] == n and want - 1e-9 <= total <= want + excess


def test_plain_cuts_hold_the_limit(enc, sentence):
    for text in ("".join(sentence(i) for i in range(30)), "😀👩‍🔬𠀀" * 60, "a" * 900, "甲"):
        for limit, overlap in ((32, 8), (9, 7)):
            pieces = splitting._plain_cuts(enc, text, token_ends(enc, text), limit, overlap)
            assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(n <= limit and len(enc.encode_ordinary(text[a:b])) == n for a, b, n in pieces)
            assert all(a < c <= b < d for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]))


def test_pieces_table(spark, sentence):
    big = "".join(sentence(i) for i in range(200))
    d = docs(spark, [(1, big, "s"), (2, "短", None), (3, None, None), (4, "", "s")])
    limits = spark.createDataFrame([("default", 512, 64)], "policy string, max_tokens int, overlap_tokens int")
    rows = splitting.pieces(d, limits).orderBy("piece_no").collect()
    assert {r.doc_id for r in rows} == {1} and [r.piece_no for r in rows] == list(range(1, rows[0].pieces + 1)) and all(r.tokens <= 512 and big[r.start : r.end] == r.text for r in rows)
    assert [r.doc_id for r in splitting.oversized(d, limits).collect()] == [1]
    assert splitting.pieces(d.limit(0), limits).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(d, limits.limit(0))
    with pytest.raises(ValueError):
        splitting.pieces(d, limits.withColumn("overlap_tokens", limits.max_tokens))
