import pytest
from pyspark.sql import functions as F

from itemweave.operators import lookup, scanned_bank as S


def test_mandatory_and_answers(spark, items):
    q = items({}, {})
    a = spark.createDataFrame([(1, 1, "B", "e1"), (1, 2, "C", "e2")], "unit int, number int, answer string, explanation string")
    assert {(r.id[-3:], r.answer) for r in lookup.with_answers(q, a).collect()} == {("001", "B"), ("002", "C")}
    with pytest.raises(lookup.MissingKeys):
        lookup.with_answers(q, a.limit(1))


def test_corrections_by_source_number(spark):
    s = "id string, subject_id string, source_question_number int, number int, options map<string,string>, shared_options map<string,string>"
    q = spark.createDataFrame([("a", "s", 5, 1, {"A": "x"}, {"A": "x"}), ("b", "s", 5, 2, {"A": "x"}, None), ("c", "s", 6, 3, {"A": "y"}, None)], s)
    c = spark.createDataFrame(
        [("1", "s", 5, "A", "x", "z", ["a", "b"]), ("2", "s", 5, "A", "x", "z", ["a"]), ("3", "s", 6, "A", "x", "z", ["c"]), ("4", "s", 9, "A", "x", "z", [])],
        "correction_id string, subject_id string, source_question_number int, letter string, before string, after string, expected_ids array<string>",
    )
    assert {r.correction_id: r.status for r in lookup.corrected_options(q, c).collect()} == {"1": "ok", "2": "other-items", "3": "changed", "4": "changed"}
    rows = {r.id: (r.options, r.shared_options) for r in lookup.corrected(q, c, strict=False).collect()}
    assert rows == {"a": ({"A": "z"}, {"A": "z"}), "b": ({"A": "z"}, None), "c": ({"A": "y"}, None)}
    with pytest.raises(lookup.CorrectionConflict, match="2: other-items, 3: changed"):
        lookup.corrected(q, c)
    assert lookup.corrected(q, c.filter("correction_id = '1'")).count() == 3 == lookup.corrected(q, c.limit(0)).count()


def test_evidence(spark):
    b = spark.createDataFrame([("q",)], "id string")
    a = spark.createDataFrame([("q", ["s2", "s1"])], "id string, source_ids array<string>")
    s = spark.createDataFrame([("s1", "o"), ("s2", "p")], "source_id string, organization string")
    r = lookup.evidence(b, a, s).first()
    assert (r.source_ids, r.organizations, r.corroborated) == (["s2", "s1"], 2, True)
    with pytest.raises(lookup.MissingKeys):
        lookup.evidence(b, a, s.limit(1))
    assert lookup.undisputed(b, b).count() == 0


def test_views_of_a_session(spark, items):
    g = {"type": "A3", "group_id": "g"}
    bank = items(g | {"id": "a"}, g | {"id": "b"}, {"id": "c"}, g | {"id": "d", "group_id": "h"})
    graded = spark.createDataFrame([("s", 1, "a", False), ("s", 2, "b", False), ("s", 3, "c", False), ("s", 4, "d", True)], "session_id string, pos int, question_id string, right boolean")
    rows = {r.block: (r.first_wrong, r.wrong_ids) for r in lookup.result_groups(graded, bank).collect()}
    assert rows == {"g": (1, ["a", "b"]), "c": (3, ["c"])}
    order = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, pos int")
    assert lookup.next_after_removal(order, "b") == "c" and lookup.next_after_removal(order, "c") == "b" and lookup.next_after_removal(order.limit(0), "x") is None
    pages = spark.createDataFrame([("a", 1), ("b", 2)], "id string, page_no int")
    assert [lookup.page_of(pages, n).first().id for n in (0, 1, 2, 99)] == ["a", "a", "b", "b"]
    said = [("s", 1, "A1/A2"), ("s", 2, "A1/A2"), ("s", 3, "A3"), ("t", 1, "B1"), ("t", 2, "A1/A2"), ("u", 3, "B1"), ("u", 2, "A3"), ("u", 1, "A1/A2"), ("u", 4, "A1/A2")]
    cur = lookup.type_cursor(spark.createDataFrame(said, "session_id string, ts int, type string"), ["A1/A2", "A3", "B1"], ["ts"]).collect()
    assert {r.session_id: (r.current_type, r.locked, r.submitted) for r in cur} == {"s": ("B1", ["A1/A2", "A3"], False), "t": ("A3", ["A1/A2"], False), "u": ("B1", ["A1/A2", "A3"], True)}
    book = spark.createDataFrame([("a",), ("zz",)], "question_id string")
    assert [r.id for r in lookup.pruned_ids(spark.createDataFrame([("a", 1), ("b", 2), ("zz", 3)], "id string, pos int"), book, bank).collect()] == ["a"]
    assert lookup.explained(items({}, {"explanation": "无"}, {"explanation": " "}, {"explanation": None}), "无").count() == 1
    row = items({"options": {"A": " x "}}).select(lookup.option_signature(F.col("options")).alias("s"), lookup.next_version(F.lit(None).cast("int")).alias("v"), lookup.sync_hash(F.lit("a"), F.lit("b")).alias("h")).first()
    assert row.s == "A:x|B:|C:|D:|E:" and row.v == 1 and len(row.h) == 64
    z = lookup.zip_readings(*(spark.createDataFrame([(1, t)], "ord int, text string") for t in "xy"))
    assert tuple(z.first()) == (1, "x", "y")


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_cleaning_of_scanned_text(spark):
    clean = lambda t: one(spark, t, lambda c: S.rewritten(c, {"甲于": "甲子"}, ["某水印"], ["第[^页]{0,8}页"]))
    assert clean("甲于之病。12.某水印") == "甲子之病" and clean("正文第12页以后") == "正文" and clean("完。 45.") == "完。" and clean(None) == ""
    assert one(spark, "选AO再", S.restored_stops) == "选A。再"
    assert one(spark, "12.【解析】本题。13.患者", lambda c: S.without_anchor(c, F.lit(12), F.lit(13))) == "本题。"
    assert one(spark, "剂量13.5克", lambda c: S.without_anchor(c, F.lit(12), F.lit(13))) == "剂量13.5克"
    assert one(spark, "乱码解析】正 文。", S.plain_explanation) == "正文"
    assert [one(spark, t, S.is_missing) for t in ("【解析】略", "12", "实记题。", "正文")] == [True, True, True, False]
    assert one(spark, "【1】甲。【2】乙。", S.group_parts) == {1: "甲", 2: "乙"} and one(spark, "无标", S.group_parts) == {}
    assert one(spark, "甲证用乙。丙证用丁。", lambda c: S.focused(c, F.lit("丁"))) == "丙证用丁"
    assert one(spark, "ⅠI)O后", S.restored_stops) == "ⅠD。后" and one(spark, "BOX", S.restored_stops) == "BOX"
    cut = lambda t: one(spark, t, lambda c: S.without_anchor(c, F.lit(7), F.lit(8)))
    assert [cut(t) for t in ("甲。7、乙", "甲9.乙8.【解析】丙", "o7.解析】甲", "17.乙在首", "甲。17.乙")] == ["甲。", "甲9.乙", "甲", "17.乙在首", "甲。17.乙"]
    assert one(spark, "甲。13.乙", lambda c: S.without_anchor(c, F.lit(None).cast("int"), F.lit(None).cast("int"))) == "甲。13.乙"
    assert one(spark, "前【1】甲；乙。【2】丙。【1】丁 戊", S.group_parts) == {1: "丁戊", 2: "丙"} and one(spark, "【1】甲【3】。", S.group_parts) == {1: "甲"}
    assert one(spark, "旧解析】新。甲 【2】乙；", S.plain_explanation) == "新。甲乙" and one(spark, None, S.plain_explanation) == ""
    assert [one(spark, t, lambda c: S.focused(c, F.lit(a))) for t, a in (("甲。乙。", "丁"), ("甲。乙。", ""), ("甲；乙甲。丙", "甲"))] == ["甲。乙", "甲。乙", "甲；乙甲"]


def test_distributed_explanations(spark, items):
    g = {"type": "B1", "group_id": "g", "answer": "A"}
    h = {"type": "B1", "group_id": "h"}
    q = items(g | {"explanation": "【1】甲。【2】乙。"}, g | {"explanation": "原文件未提供解析。"}, h | {"explanation": "独一。"}, h | {"explanation": "独二。"}, {})
    assert {r.id[-3:]: r.explanation for r in S.distributed_explanations(q).collect()} == {"001": "甲。", "002": "乙。"}


LINES = "paper string, page int, column int, row int, line int, text string"


def lines(spark, *texts):
    return spark.createDataFrame([("p", 1, 1, 1, n, t) for n, t in enumerate(texts)], LINES)


def test_answer_entries(spark):
    df = lines(spark, "前言", "1.【答案】A", "解析一", "续一", "2.", "【答案】B", "3.答案C", "解析三")
    rows = S.answer_entries(df, ["paper"]).orderBy("entry").collect()
    assert [(r.number, r.answer, r.explanation) for r in rows] == [(1, "A", "一续一"), (2, "B", ""), (3, "C", "三")]


def test_option_sets(spark):
    df = lines(spark, "1.题干", "A.甲", "B.乙", "续", "C.丙", "D.丁", "F.戊", "2.题", "甲甲", "B.乙", "D.丁", "E.戊", "A.单")
    rows = S.option_sets(df, ["paper"]).orderBy("set_no").collect()
    assert rows[0].options == {"A": "甲", "B": "乙续", "C": "丙", "D": "丁", "E": "戊"} and rows[0].context == ["1.题干"] and rows[0].missing == []
    assert rows[1].options["A"] == "甲甲" and rows[1].missing == ["C"] and rows[1].context == ["2.题"] and rows[2].missing == ["B", "C", "D", "E"]


def test_layout_and_carry(spark):
    r = spark.createDataFrame([(2021, 1, "A1/A2", 1, 2, 1), (2021, 1, "B1", 3, 7, 2)], "year int, unit int, type string, first int, last int, size int")
    got = {(x.number, x.set_first, x.group_id) for x in S.layout(r).collect()}
    assert got == {(1, 1, None), (2, 2, None), (3, 3, "2021-U1-B1-003-004"), (4, 3, "2021-U1-B1-003-004"), (5, 5, "2021-U1-B1-005-006"), (6, 5, "2021-U1-B1-005-006"), (7, 7, "2021-U1-B1-007-007")}
    m = S.range_members(lines(spark, "(2～4题共用题干)", "正文")).collect()
    assert [(x.kind, x.number) for x in m] == [("A3", 2), ("A3", 3), ("A3", 4)]
    df = spark.createDataFrame([("p", 1, None), ("p", 2, "a"), ("p", 3, None), ("p", 4, "b")], "paper string, n int, unit string")
    assert [x.unit for x in S.carried(df, ["paper"], ["n"], ["unit"]).orderBy("n").collect()] == [None, "a", "a", "b"]
    assert [x.segment for x in S.segments(df, ["paper"], ["n"], F.col("unit").isNotNull()).orderBy("n").collect()] == [0, 1, 1, 2]


def test_resumable_sessions(spark, items):
    from itemweave.operators import sessions

    bank = items({"id": "a", "subject_id": "s"}, {"id": "b", "subject_id": "t"})
    base = {"mode": "review", "bank_version": "v5", "paper_format_version": "1", "blueprint_version": None, "source": None, "subject_id": None, "subject_bank_version": None, "question_ids": ["a", "b"]}
    cases = {
        "ok": {}, "mode": {"mode": "other"}, "null": {"mode": None}, "old": {"bank_version": "v4"}, "none": {"question_ids": []}, "gone": {"question_ids": ["a", "x"]}, "nullid": {"question_ids": ["a", None]},
        "subject": {"source": "subject", "subject_id": "s", "subject_bank_version": "n1", "question_ids": ["a"]}, "other": {"source": "subject", "subject_id": "s", "subject_bank_version": "n1"},
        "late": {"source": "subject", "subject_id": "s", "subject_bank_version": "n9", "question_ids": ["a"]}, "exam": {"mode": "exam", "blueprint_version": "b1"}, "exam-old": {"mode": "exam", "blueprint_version": "b0"},
    }
    schema = "session_id string, mode string, bank_version string, paper_format_version string, blueprint_version string, source string, subject_id string, subject_bank_version string, question_ids array<string>"
    rows = spark.createDataFrame([{"session_id": k, **base, **v} for k, v in cases.items()], schema)
    versions = {"review": {"bank_version": "v5", "paper_format_version": "1"}, "exam": {"bank_version": "v5", "blueprint_version": "b1", "paper_format_version": "1"}}
    got = {r.session_id: r.reason for r in sessions.resumable(rows, bank, versions, ["n1", "n0"]).collect()}
    assert got == {"ok": None, "mode": "mode", "null": "mode", "old": "version", "none": None, "gone": "question", "nullid": "question", "subject": None, "other": "subject", "late": "subject-version", "exam": None, "exam-old": "version"}
    assert sessions.resumable(rows.limit(0), bank, versions, []).count() == 0
    df = spark.createDataFrame([("n1",), ("n2",), (None,)], "v string")
    assert [r[0] for r in df.select(sessions.compatible(F.col("v"), "n2", ["n0"])).collect()] == [False, True, False]


def test_disputes_and_codes(spark):
    b, d = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in ("ab", "cd"))
    assert lookup.settled(b, d, 2).count() == 2
    for wrong in ((b, d, 5), (b, b, 2)):
        with pytest.raises(ValueError):
            lookup.settled(*wrong)
    code = spark.createDataFrame([("x",)], "s string").select(lookup.sync_code(F.col("s"))).first()[0]
    assert len(code) == 11 and code[5] == "-" and set(code) - {"-"} <= set(lookup.CODE_LETTERS)
