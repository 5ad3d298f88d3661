import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from itemweave import schema
from itemweave.operators import paper


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=20), st.integers(0, 30))
def test_choose_blocks(sizes, target):
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums}
    if target in sums:
        picked = paper.choose_blocks(sizes, target)
        assert sum(sizes[i] for i in picked) == target and len(set(picked)) == len(picked)
    else:
        with pytest.raises(ValueError):
            paper.choose_blocks(sizes, target)
    most = paper.choose_blocks(sizes, target, at_most=True)
    assert sum(sizes[i] for i in most) == max((x for x in sums if x <= target), default=0)


def grouped_bank(n):
    rng, rows, pos = random.Random(2), [], 0
    for unit in (1, 2, 3, 4):
        for kind in schema.TYPES:
            made = 0
            while made < n:
                size = 1 if kind == "A1/A2" else rng.choice([2, 2, 3])
                gid = None if size == 1 else f"g{unit}{kind}{made}"
                for _ in range(size):
                    pos += 1
                    rows.append({"id": f"q{pos:05d}", "unit": unit, "type": kind, "group_id": gid, "bank_ord": pos, "number": pos})
                made += size
    return rows


def test_exam_papers_and_pages(spark, items):
    bank = items(*grouped_bank(150))
    plan = schema.blueprint(spark)
    first = paper.exam_paper(bank, plan, 1).select("unit", "paper_pos", "id", "type", "group_id", "section_ord")
    rows = first.collect()
    want = {(u, t): n for u, _, t, n in schema.BLUEPRINT}
    assert Counter((r.unit, r.type) for r in rows) == want and len({r.id for r in rows}) == len(rows) == 600
    sizes = Counter(r.group_id for r in bank.collect() if r.group_id)
    assert all(n == sizes[g] for g, n in Counter(r.group_id for r in rows if r.group_id).items())
    for unit in (1, 2, 3, 4):
        ordered = sorted((r for r in rows if r.unit == unit), key=lambda r: r.paper_pos)
        assert [r.section_ord for r in ordered] == sorted(r.section_ord for r in ordered)
    second = {r.id for r in paper.exam_paper(bank, plan, 2).select("id").collect()}
    assert second != {r.id for r in rows} and {r.id for r in paper.exam_paper(bank, plan, 1).select("id").collect()} == {r.id for r in rows}
    # pages against the greedy rule
    paged = paper.pages(first, ["unit"]).collect()
    for unit in (1, 2, 3, 4):
        blocks, page, used, kind, want_page = defaultdict(list), 0, 0, None, {}
        for r in sorted((r for r in rows if r.unit == unit), key=lambda r: r.paper_pos):
            blocks[r.group_id or r.id].append(r)
        for name, members in blocks.items():
            if page == 0 or kind != members[0].type or used + len(members) > 10:
                page, used, kind = page + 1, 0, members[0].type
            used += len(members)
            want_page |= {m.id: page for m in members}
        assert {r.id: r.page_no for r in paged if r.unit == unit} == want_page


def test_small_pool_raises(spark, items):
    with pytest.raises(Exception, match="no whole blocks"):
        paper.exam_paper(items(*grouped_bank(10)), schema.blueprint(spark), 1).count()


def test_reviews(spark, items):
    bank = items(*grouped_bank(12))
    rows = paper.review_paper(bank, 25, 3).orderBy("paper_pos").collect()
    assert len(rows) == 25 and [schema.TYPES.index(r.block_type) for r in rows] == sorted(schema.TYPES.index(r.block_type) for r in rows)
    assert paper.review_paper(bank, 0, 3).count() == 10
    assert paper.review_paper(bank, 10**6, 3).count() == bank.count()
    only = bank.filter("type = 'B1' and unit = 1")
    got = paper.review_paper(only, 3, 3, at_most=True).count()
    assert got in (2, 3)


def test_mistake_order_keeps_groups_together(spark, items):
    bank = items({"id": "A-1", "type": "A3", "group_id": "a", "number": 1}, {"id": "A-2", "type": "A3", "group_id": "a", "number": 2}, {"id": "S-1"}, {"id": "B-1", "type": "B1", "group_id": "b", "number": 1}, {"id": "B-2", "type": "B1", "group_id": "b", "number": 2})
    ids = spark.createDataFrame([(x,) for x in "A-2 S-1 A-1 B-2 B-1 missing S-1".split()], "id string")
    order = [r.id for r in paper.mistake_order(ids, bank, 1).orderBy("pos").collect()]
    assert sorted(order) == ["A-1", "A-2", "B-1", "B-2", "S-1"]
    assert order.index("A-2") == order.index("A-1") + 1 and order.index("B-2") == order.index("B-1") + 1
