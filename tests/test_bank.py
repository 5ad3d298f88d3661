import random

import pytest
from pyspark.sql import functions as F

from itemweave.operators import bank, dedup, merge, patches, sequence
from itemweave.operators import components
from itemweave.operators.components import connected_components
from itemweave.operators.skew import lookup_join


def test_text_fields_and_union(spark, items):
    a = items({"stem": None, "prompt": "问"})
    b = items({"id": "x", "shared_options": {"A": "甲"}}).drop("shared_stem")
    both = bank.union_banks(a, b)
    assert sorted((r.id, r.bank_no) for r in both.select("id", "bank_no").collect()) == [("2099-U1-001", 0), ("x", 1)]
    fields = {(r.id, r.field, r.field_group) for r in bank.text_fields(both).collect()}
    assert ("2099-U1-001", "prompt", "stem") in fields and ("2099-U1-001", "stem", "stem") not in fields and ("x", "shared-option-A", "option") in fields
    assert bank.text_fields(a.limit(0)).count() == 0


PATCH = "patch_id long, id string, field string, before string, after string"


def test_patches_apply_only_to_the_text_they_name(spark, items):
    q = items({}, {"explanation": None}, extra={"fixes_": "string"})
    rows = [
        (1, "2099-U1-001", "stem", "题干0", "新"), (2, "2099-U1-001", "stem", "题干0", "再"), (3, "2099-U1-001", "option-B", "B项0", "乙"),
        (4, "2099-U1-002", "stem", "不同", "x"), (5, "no", "stem", "a", "b"), (6, "2099-U1-002", "explanation", None, "补"), (7, "2099-U1-002", "number", "2", "3"),
    ]
    p = spark.createDataFrame(rows, PATCH)
    status = {r.patch_id: r.status for r in patches.patch_status(q, p).collect()}
    assert status == {1: "ok", 2: "duplicate", 3: "ok", 4: "changed", 5: "unknown-id", 6: "ok", 7: "unknown-field"}
    with pytest.raises(patches.PatchConflict, match="changed: 1, duplicate: 1, unknown-field: 1, unknown-id: 1"):
        patches.apply_patches(q, p)
    new = {r.id: r for r in patches.apply_patches(q, p, strict=False).collect()}
    assert new["2099-U1-001"].stem == "新" and new["2099-U1-001"].options["B"] == "乙" and new["2099-U1-001"].options["A"] == "A项0"
    assert new["2099-U1-002"].stem == "题干1" and new["2099-U1-002"].explanation == "补"
    assert patches.apply_patches(q, p.limit(0)).select("id", "stem").collect() == q.select("id", "stem").collect()


def test_backfill_needs_its_marker(spark, items):
    b = spark.createDataFrame([("2099-U1-001", "解析0。", "长解析。（由AI查询）"), ("2099-U1-002", "解析1。", "长解析。")], "id string, before string, after string")
    status = {r.id: r.status for r in patches.backfill_status(items({}, {}), b, "（由AI查询）").collect()}
    assert status == {"2099-U1-001": "ok", "2099-U1-002": "no-marker"}


def test_keep_first(spark, items):
    q = items({"stem": "同"}, {"stem": "同"}, {"stem": ""}, {"stem": ""}, {"stem": None}, {"stem": "异"})
    rows = {r.id[-3:]: (r.first_id[-3:], r.duplicate) for r in dedup.keep_first(q, F.col("stem"), "bank_ord").collect()}
    assert rows == {"001": ("001", False), "002": ("001", True), "003": ("003", False), "004": ("004", False), "005": ("005", False), "006": ("006", False)}


def test_block_dedup_ignores_member_order(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 3), ("b", "x", 4), ("c", "x", 5)], "block string, fp string, ord int")
    assert {(r.block, r.kept_block) for r in dedup.block_dedup(df, "fp", "block", "ord").collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def sequential(rows):
    seen, out, blocks = set(), {}, {}
    for block, key, ord_ in sorted(rows, key=lambda r: r[2]):
        blocks.setdefault(block, []).append(key)
    for block, keys in blocks.items():
        keys = {k for k in keys if k}
        out[block] = bool(keys & seen)
        if not out[block]:
            seen |= keys
    return out


@pytest.mark.parametrize("seed", range(4))
def test_sequential_block_dedup_against_the_sequence(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for b in range(30):
        for _ in range(rng.randint(1, 3)):
            rows.append((f"b{b:02d}", rng.choice(["", "hot", *(f"k{i}" for i in range(25))]), n))
            n += 1
    df = spark.createDataFrame(rows, "block string, key string, ord int")
    got = {r.block: r.dropped for r in dedup.sequential_block_dedup(df, "key", "block", "ord").collect()}
    assert got == sequential(rows)


def test_lookup_join_splits_hot_keys(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, v int")
    look = spark.createDataFrame([("a", 50, "hot"), ("b", 1, "cold"), ("c", 0, "none")], "k string, n long, w string")
    for hot in (10, 1000):
        assert sorted(r.w for r in lookup_join(rows, look, "k", "n", hot_rows=hot).collect()) == ["cold"] + ["hot"] * 50


def test_components(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, i) for i in range(101, 140)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in list(parent)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    monkeypatch.setattr(components, "HOT_ROWS", 0)  # minima by lookup
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == got


def test_merge_rules(spark):
    s = "collection string, key string, version int, updated_at string, payload string"
    local = [("s", "a", 2, "t1", "L"), ("s", "b", 1, "t1", "L"), ("s", "c", 1, "t1", "L"), ("s", "only", None, None, "L"), ("s", "n", None, "t1", "L"), ("s", None, 9, "t", "L")]
    remote = [("s", "a", 1, "t9", "R"), ("s", "b", 1, "t2", "R"), ("s", "c", 1, "t1", "R"), ("s", "new", 1, "t", "R"), ("s", "n", 0, None, "R")]
    got = {r.key: r.payload for r in merge.merge_replicas(spark.createDataFrame(local, s), spark.createDataFrame(remote, s)).collect()}
    assert got == {"a": "L", "b": "R", "c": "L", "only": "L", "new": "R", "n": "L"}
    assert merge.merge_queues([1, 2, 1], [3, 2]) == [1, 2, 3]
    m = spark.createDataFrame([("l", "t1", False), ("r", "t2", False), ("d", "t9", True)], "key string, updated_at string, completed boolean")
    assert merge.cursor(m, "l", "r") == "r" and merge.cursor(m, "r", "l") == "r" and merge.cursor(m, None, "d") is None and merge.cursor(m, "l", "d") == "l"


def test_group_checks(spark, items):
    g = {"type": "A3", "group_id": "g", "group_start": 1, "group_end": 2, "shared_stem": "共", "prompt": "问"}
    bad = {"type": "A3", "group_id": "h", "group_start": 3, "group_end": 5, "shared_stem": "共", "prompt": "问"}
    q = items(g, g, bad, bad | {"shared_stem": "别", "unit": 2})
    ranges = {r.group_id: r.complete for r in sequence.group_ranges(q).collect()}
    assert ranges == {"g": True, "h": False}
    assert {(r.group_id, r.kind) for r in sequence.group_conflicts(q).collect()} == {("h", "group-scope-conflict"), ("h", "shared-stem-conflict")}
    assert {r.group_id: r.contiguous for r in sequence.group_contiguity(q, "bank_ord").collect()} == {"g": True, "h": True}
    nxt = {r.id[-3:]: r.next_exists for r in sequence.next_number(q).collect()}
    assert nxt == {"001": True, "002": True, "003": False, "004": False}


def test_numbered_is_a_total_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("v"))
    rows = sequence.numbered(df, "v").collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.pos)] == sorted(r.v for r in rows) and {r.pos for r in rows} == set(range(1, 501))
