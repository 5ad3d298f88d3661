import pytest

from itemweave.operators import validate
from itemweave.sources import papers

PAPER = [
    "第一单元", "A1/A2型题", "1. 单题题干", "A. 甲 B. 乙 C. 丙", "D. 丁 E. 戊", "答案：C", "解析：因为丙。2．粘连题 A. 一 B. 二 C. 三 D. 四 E. 五 答案：A", "A3/A4型题",
    "共用题干：患者腹痛", "3. 首问", "A. a B. b C. c D. d E. e", "4. 次问", "A. f B. g C. h D. i E. j", "B型题", "（5～6题共用备选答案）", "A. 甲 B. 乙", "C. 丙 D. 丁 E. 戊",
    "5. 问五", "答案：B", "6. 问六 剂量13.5克", "第二单元", "1. 无选项",
]


def test_paper():
    items = papers.parse(PAPER, 2024)
    assert [(x["unit"], x["number"], x["type"]) for x in items] == [(1, 1, "A1/A2"), (1, 2, "A1/A2"), (1, 3, "A3"), (1, 4, "A3"), (1, 5, "B1"), (1, 6, "B1"), (2, 1, "A1/A2")]
    one, glued, a3, _, b1, b1b, last = items
    assert one["options"] == {"A": "甲", "B": "乙", "C": "丙", "D": "丁", "E": "戊"} and one["answer"] == "C" and one["explanation"] == "因为丙。"
    assert glued["stem"] == "粘连题" and glued["answer"] == "A" and glued["options"]["E"] == "五"
    assert a3["stem"] == "患者腹痛 首问" and (a3["group_start"], a3["group_end"]) == (3, 4) and a3["shared_stem"] == "患者腹痛"
    assert b1["group_id"] == "2024-U1-B1-005-006" and b1["shared_options"]["D"] == "丁" and b1b["stem"] == "问六 剂量13.5克" and b1b["answer"] is None
    assert last["options"] == dict.fromkeys("ABCDE", "") and papers.parse([], 2024) == []


def test_option_chunks():
    assert papers.option_chunks("A. x B. y A. z") == [{"A": "x", "B": "y"}, {"A": "z"}] and papers.option_chunks("无") == []


def test_papers_as_a_table(spark):
    df = spark.createDataFrame([("p", 2024, n, t) for n, t in enumerate(PAPER)], "paper string, year int, pos int, text string")
    rows = papers.parse_papers(df).collect()
    assert len(rows) == 7 and {r.group_start for r in rows} == {None, 3, 5}


def test_answers():
    got = papers.answers(["【答案】A【解析】甲。", "续", "2.", "乙文", "答案：C 略"], {2: "B"})
    assert got == [(1, "A", "甲。 续"), (2, "B", "2. 乙文"), (3, "C", "略")]
    with pytest.raises(ValueError):
        papers.answers(["答案：A"], {2: "B"})


def test_validation(spark, items):
    q = items({}, {"unit": 2, "stem": " ", "answer": "X", "options": {"A": "a"}})
    want = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "unit int, expected int")
    assert {(r.unit, r.expected, r.actual) for r in validate.expected_counts(q, want, ["unit"]).collect()} == {(2, 2, 1), (3, 1, 0)}
    assert {r.problem for r in validate.incomplete_items(q).collect()} == {"stem", "answer", "option-B", "option-C", "option-D", "option-E"}
    s = spark.createDataFrame([("x", "科", "某.txt", 3), ("y", "甲.txt", "甲.txt", 0)], "subject_id string, subject_name string, source_file_name string, count int")
    assert {tuple(r) for r in validate.subject_reconciliation(q, s).collect()} == {("x", "count"), ("y", "empty"), ("y", "file-name")}


def test_fused_readings(spark):
    f = "ord int, field string, text string"
    a = spark.createDataFrame([(1, "stem", "甲乙丙丁"), (2, "stem", " ")], f)
    b = spark.createDataFrame([(1, "stem", "子丑寅卯"), (2, "stem", "补"), (9, "stem", "外")], f)
    layout = spark.createDataFrame([(1,), (2,), (3,)], "ord int")
    fused, wrong = validate.fuse_readings(layout, [a, b])
    assert {(r.ord, r.text) for r in fused.collect()} == {(1, "甲乙丙丁"), (2, "补")} and [(r.ord, r.ratio) for r in wrong.collect()] == [(1, 0.0)]
    answers = spark.createDataFrame([(1, "A"), (2, "Z")], "ord int, answer string")
    assert {tuple(r) for r in validate.excluded(layout, fused, answers, ["stem"]).collect()} == {(2, "answer"), (3, "field")}
