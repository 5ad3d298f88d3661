from itemweave.operators import quality


def kinds(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_scan_cases(spark, items):
    q = items(
        {"stem": "医 学测试题", "explanation": "正常解析。2. 【一点笔记】。"}, {"stem": "异常 O 字符"}, {"stem": "霍乱O139血清型"}, {"stem": "甲（乙"}, {"stem": None, "explanation": ""},
    )
    found = kinds(quality.scan_candidates(q), "id", "field", "issue_type")
    first = {(f, k) for i, f, k in found if i.endswith("001")}
    assert {("stem", "internal-cjk-whitespace"), ("explanation", "watermark-or-source-noise"), ("explanation", "possible-next-question-number")} <= first
    assert ("2099-U1-002", "stem", "suspicious-ocr-symbol") in found and not any(i.endswith("003") for i, _, _ in found)
    assert ("2099-U1-004", "stem", "unbalanced-brackets") in found


def test_missing_explanations(spark, items):
    q = items({"explanation": "D略。【一点笔记】。"}, {"explanation": "暂无。"}, {"explanation": " 　"}, {"explanation": None}, {"explanation": "略述如下。"})
    assert {(i[-3:], k) for i, k in kinds(quality.missing_explanations(q), "id", "issue_type")} == {
        ("001", "missing-explanation-unusable"), ("002", "missing-explanation-placeholder"), ("003", "missing-explanation-empty"), ("004", "missing-explanation-empty")
    }


def test_answer_conflicts(spark, items):
    options = {"A": "甲", "B": "乙", "C": "丙", "D": "丁", "E": "戊"}
    moved = {"A": "乙", "B": "甲", "C": "丙", "D": "丁", "E": "戊"}
    q = items({"stem": "同题", "options": options, "answer": "A"}, {"stem": "同 题！", "options": moved, "answer": "A"}, {"stem": "他题", "options": options, "answer": "A"}, {"stem": "他题", "options": moved, "answer": "B"})
    assert kinds(quality.answer_conflicts(q), "first_id", "members", "answers") == {("2099-U1-001", 2, 2)}


def test_structural_issues(spark, items):
    q = items(
        {"stem": "", "answer": "F", "type": "C"}, {"options": {"A": "a", "B": "b"}, "explanation": "略。"}, {"id": "2020-U1-003", "explanation": "实记题。"},
        {"type": "B1", "group_id": "g", "prompt": None}, {"group_id": "z"}, {"id": "2099-U1-005", "stem": "题干4", "options": {k: f"{k}项4" for k in "ABCDE"}},
        {"stem": "答案：A"}, {"stem": "前文。9.患者"},
    )
    got = kinds(quality.structural_issues(q), "id", "severity", "kind", "field")
    short = {(i[-3:], s, k) for i, s, k, _ in got}
    assert {("001", "error", "missing-stem"), ("001", "error", "invalid-answer"), ("001", "error", "invalid-type")} <= short
    assert ("002", "error", "invalid-option-keys") in short and len([x for x in got if x[0].endswith("002") and x[2] == "missing-option"]) == 3
    assert ("002", "warning", "placeholder-explanation") in short and ("003", "error", "placeholder-explanation") in short
    assert {("004", "error", "missing-group-prompt"), ("004", "error", "invalid-shared-options"), ("005", "error", "unexpected-group-id")} <= short
    assert ("005", "error", "duplicate-id") in short and ("005", "error", "duplicate-question-content") in short
    assert ("007", "error", "embedded-answer-marker") in short
    assert quality.structural_issues(q.limit(0)).count() == 0


def test_subject_rules(spark, items):
    q = items(
        {"explanation": "故选B。", "answer": "A"}, {"explanation": "答案为a", "answer": "A"},
        {"answer": "A", "options": {"A": "甲甲", "B": "乙乙", "C": "c", "D": "d", "E": "e"}, "explanation": "此处只有乙乙。"}, {"explanation": "相同。"}, {"explanation": " 相同 "},
    )
    assert {(i[-3:], s) for i, s in kinds(quality.stated_answer_conflicts(q), "id", "stated")} == {("001", "B")}
    assert {i[0][-3:] for i in kinds(quality.answer_not_explained(q), "id")} == {"003"}
    assert kinds(quality.repeated_explanations(q), "first_id", "members", "groups") == {("2099-U1-004", 2, 2)}
    b = {"type": "B1", "group_id": "g"}
    assert [r.policy for r in quality.explanation_policy(items(b | {"explanation": "同"}, b | {"explanation": "同"})).collect()] == ["shared"]
    assert [r.policy for r in quality.explanation_policy(items(b | {"explanation": ""}, b | {"explanation": "同"})).collect()] == ["merged"]


def test_group_members(spark, items):
    same = {k: k for k in "ABCDE"}
    b = {"type": "B1", "group_id": "g", "prompt": "问", "options": same, "shared_options": same}
    q = items(b, b, b | {"group_id": "h"}, b | {"group_id": "i", "prompt": " "}, b | {"group_id": "i", "options": same | {"A": "x"}}, {"stem": "【配伍题】（）"}, {"stem": "A1型题"}, {"stem": "A1型题干"})
    assert kinds(quality.group_member_issues(q), "group_id", "kind") == {("h", "single"), ("i", "blank-prompt"), ("i", "options")}
    assert {i[0][-3:] for i in kinds(quality.placeholder_stems(q), "id")} == {"006", "007"}
