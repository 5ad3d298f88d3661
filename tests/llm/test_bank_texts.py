"""p1 to p6: fixtures with planted cases, held-out accuracy, and awkward inputs."""

import random

import pytest

from itemweave.llm import edges, format_dups, lookalike, residue, scan_repair, site_lines, truncation


def ids(df):
    return {r.id for r in df.select("id").collect()}


# ---- p1


def plain_bank(items, sentence, n=300, more=()):
    rows = [{"id": f"a{i:04d}", "explanation": "".join(f"若{sentence((i, k), 6)[:-1]}，当从{sentence((i, k, 1), 3)[:-1]}证论治。" for k in range(3))} for i in range(n)]
    return items(*rows, *more)


def test_truncated_endings(items, sentence):
    whole = "若肝心脾肺肾胆，当从气血阴证论治。"
    more = [
        {"id": "cut1", "explanation": whole + "若肝心脾肺"}, {"id": "cut2", "explanation": whole + "若肝心脾肺肾胆，当从…"}, {"id": "cut3", "explanation": whole + "若肝心脾肺肾胆，当</"},
        {"id": "cut4", "explanation": whole + "若肝心�"}, {"id": "ok1", "explanation": whole + "若肝心脾肺肾胆，当从气血阴证论治"}, {"id": "ok2", "explanation": whole + "故选A"},
        {"id": "ok3", "explanation": None}, {"id": "ok4", "explanation": " "}, {"id": "ok5", "explanation": "暂无解析"}, {"id": "ok6", "explanation": whole + "（" + whole[:-1] + "）"},
    ]
    q = plain_bank(items, sentence, more=more)
    assert {i for i in ids(truncation.found(q)) if not i.startswith("a")} == {"cut1", "cut2", "cut3", "cut4"}
    shares = {r.source: (r.explanations, r.truncated) for r in truncation.by_source(q).collect()}
    assert shares == {"s1": (308, 4 + len([i for i in ids(truncation.found(q)) if i.startswith("a")]))}


def test_truncated_copy_is_found_by_alignment(items, sentence):
    body = "".join(sentence(i) for i in range(12))
    last = "终至心脾两虚之证候群"
    q = plain_bank(items, sentence, more=[{"id": "full", "explanation": body + last + "须久服。"}, {"id": "cut", "explanation": body + last}, {"id": "done", "explanation": body + last + "须久服"}])
    rows = {r.id: r.evidence for r in truncation.truncated(q).collect()}
    assert rows.get("cut") == "copy" and "done" not in rows and "full" not in rows


def test_source_line_after_a_whole_statement(items, sentence):
    q = items(*({"id": f"b{i}", "explanation": sentence(i) + "\n某某讲堂 版权所有"} for i in range(30)), {"id": "only", "explanation": "某某讲堂 版权所有"})
    assert ids(truncation.found(q)) == set()


def test_compare():
    assert truncation.compare("甲乙丙丁戊己庚辛壬癸子丑寅", "甲乙丙丁戊己庚辛壬癸子丑寅卯。") == 1
    assert truncation.compare("甲乙丙丁戊己庚辛壬癸子丑寅", "甲乙丙丁戊己庚辛壬癸子丑寅。卯") == -1
    assert truncation.compare("甲", "乙") == 0


def test_compare_asks_for_similar_texts(sentence):
    tail, body, other = "故应以健脾化湿之法治之为宜", "".join(sentence(i) for i in range(4)), "".join(sentence(i) for i in range(10, 14))
    for rest in ("且忌生冷。", "。", ""):
        assert truncation.compare(body + tail, other + tail + rest) == 0
    assert truncation.compare(body + tail, body + tail + "且忌生冷。") == 1 and truncation.compare(body + tail, body + tail + "。") == -1
    # a cut in the first tenth of the text, and a copy with one changed letter
    late = "".join(sentence(i) for i in range(20, 60))
    assert truncation.compare(body + tail, body + tail + "且忌" + late) == 1
    assert truncation.compare(body + tail, "甲" + body[1:] + tail + "且忌生冷。") == 1


def test_last_line_of_copies_is_no_formula(items, sentence):
    cut = sentence("c") + "\n若肝心脾肺"
    copies = [{"id": f"cut{i}", "explanation": cut if i % 2 else " " + cut.replace("。", " 。")} for i in range(40)]
    thanks = [{"id": f"ok{i}", "explanation": sentence((i, "t")) + "\n祝各位复习顺利"} for i in range(4)]
    q = plain_bank(items, sentence, more=[{**r, "source": f"s{n}"} for n, r in enumerate(copies + thanks)])
    keys = {r.key % 2**64 for r in truncation.formula_keys(q.selectExpr("source", "explanation as text")).collect()}
    assert keys == {truncation.line_key("祝各位复习顺利")}
    assert {i for i in ids(truncation.found(q)) if not i.startswith("a")} == {r["id"] for r in copies}


@pytest.mark.parametrize("copies", [1, 3])
def test_other_rows_change_no_case(items, sentence, copies, monkeypatch):
    """The same records in a small table and in a larger one; a broken-off line that three texts end with stays a cut."""
    same = [{"id": f"cut{i}", "explanation": sentence((i, "v")) + "\n若肝心脾肺"} for i in range(3)]
    broken = [{"id": f"b{i}", "explanation": sentence((i, "b"))[:-1] + "，且见肝\n主疏泄之证候。", "source": f"b{i}"} for i in range(4)]
    thanks = [{"id": f"ok{i}", "explanation": sentence((i, "t")) + "\n祝各位复习顺利", "source": f"t{i}"} for i in range(4)]
    q = plain_bank(items, sentence, n=200 * copies, more=same + broken + thanks)
    assert {i for i in ids(truncation.found(q)) if not i.startswith("a")} == {"cut0", "cut1", "cut2"}
    got = {r.id for r in scan_repair.repaired_fields(q).collect() if r.field == "explanation"}
    assert got == {r["id"] for r in broken}
    monkeypatch.setattr(truncation, "FORMULA_LINES", 0)  # the keys are joined to their rows instead
    assert {i for i in ids(truncation.found(q)) if not i.startswith("a")} == {"cut0", "cut1", "cut2"}
    assert {r.id for r in scan_repair.repaired_fields(q).collect() if r.field == "explanation"} == got


def test_twice_the_table_gives_the_same_rows(items, sentence):
    more = [{"id": f"cut{i}", "explanation": sentence((i, "v")) + "若肝心脾肺", "source": f"s{i}"} for i in range(5)]
    q = plain_bank(items, sentence, more=more)
    twice = q.unionByName(q.selectExpr("concat(id, 'x') as id", *(c for c in q.columns if c != "id")))
    for op, by in ((truncation.found, ["id"]), (scan_repair.found, ["id", "field"])):
        one = {tuple(r[c] for c in by) for r in op(q).collect()}
        assert {tuple(r[c] for c in by) for r in op(twice).collect() if not r.id.endswith("x")} == one


@pytest.mark.parametrize("cap", [1024, 1])
def test_copies_of_a_cut_text_and_large_buckets(items, sentence, monkeypatch, cap):
    from itemweave.llm import near_dups

    monkeypatch.setattr(near_dups, "BUCKET_CAP", cap)
    body = "".join(sentence(i) for i in range(12))
    last = "终至心脾两虚之证候群"
    more = [{"id": f"cut{i}", "explanation": body + last, "source": f"c{i}"} for i in range(30)] + [{"id": "full", "explanation": body + last + "须久服。"}, {"id": "edit", "explanation": "甲" + body + last + "须久服。"}]
    rows = {r.id: r.evidence for r in truncation.truncated(plain_bank(items, sentence, more=more)).collect() if not r.id.startswith("a")}
    assert rows == {f"cut{i}": "copy" for i in range(30)}


def test_long_marks_are_taken_off_whole():
    assert truncation.fragment("肝主疏泄。脾主" + "." * 60) == ("脾主", True) and truncation.fragment("肝主疏泄。脾主" + "…" * 40) == ("脾主", True)
    assert truncation.fragment("." * 60) == ("", False)


def test_cut_before_a_closed_formula_or_page_line(items, sentence):
    thanks = [{"id": f"ok{i}", "explanation": sentence((i, "t")) + "\n祝各位复习顺利！", "source": f"t{i}"} for i in range(4)]
    more = [{"id": f"cut{i}", "explanation": sentence((i, "u")) + "若肝心脾肺\n" + end, "source": f"u{i}"} for i, end in enumerate(("祝各位复习顺利！", "【12】", "（12）"))]
    q = plain_bank(items, sentence, more=thanks + more)
    assert {i for i in ids(truncation.found(q)) if not i.startswith("a")} == {"cut0", "cut1", "cut2"}


def test_copy_that_breaks_off_too_is_no_witness(sentence):
    text = sentence(1) + "若肝心脾肺肾胆当从气血阴阳"
    assert [truncation.compare(text, text + end) for end in ("", "…", "<", "\n- 12 -")] == [0, 0, 0, 0]
    assert [truncation.compare(text, text + end) for end in ("。", "）", "。\n- 12 -")] == [-1, -1, -1]


# ---- p2


RESIDUE = ["{{analysis}}", "${q.text}", "暂无解析", "undefined", "NaN", "404 Not Found", "请启用JavaScript后继续浏览", "[[解析待补]]", "内容加载中，请稍候", "测试测试测试123"]
REAL = ["502号标本亦同。", "此处X代表剂量。", "配伍模板一词，指组方骨架。", "其集合可写作{肝，脾，肾}三者。", "文中[3]、[4]为注释编号。"]


def test_residue(items, sentence):
    rows = [{"id": f"a{i}", "explanation": sentence(i) + sentence(i + 9999) + (REAL[i % 5] if i % 3 == 0 else "")} for i in range(400)]
    rows += [{"id": f"x{i}", "explanation": RESIDUE[i % 10]} for i in range(60)]
    rows += [{"id": f"y{i}", "explanation": sentence(i) + "考点见{{topic}}。" + sentence(i + 1)} for i in range(30)]
    rows += [{"id": "null", "explanation": None}, {"id": "empty", "explanation": ""}]
    q = items(*rows)
    want = {r["id"] for r in rows if r["id"][0] in "xy"}
    assert ids(residue.found(q)) == want
    assert ids(residue.without_residue(q)) == {r["id"] for r in rows} - want


def test_residue_on_unseen_sources(items, sentence):
    rng = random.Random(1)
    rows = [{"id": f"{s}{i}", "source": f"s{s}", "explanation": rng.choice(RESIDUE) if i % 4 == 0 else sentence((s, i)) + rng.choice(REAL)} for s in range(8) for i in range(80)]
    v = residue.validation(items(*rows)).collect()
    assert len(v) == 2 and sum(r.weak for r in v) >= 30
    assert sum(r.agreed for r in v) >= 0.95 * sum(r.weak for r in v) and sum(r.extra for r in v) <= 0.02 * sum(r.clauses for r in v)


def test_validation_counts_every_explanation_of_whole_sources(items, sentence, monkeypatch):
    monkeypatch.setattr(residue, "TRAIN_ROWS", 20)  # a sample that leaves most rows out
    rows = [{"id": f"{s}{i}", "source": f"s{s}", "explanation": RESIDUE[i % 10] if i % 4 == 0 else sentence((s, i))} for s in range(1, 8) for i in range(60)]
    rows += [{"id": "n1", "source": "s0", "explanation": None}, {"id": "n2", "source": "s0", "explanation": ""}, {"id": "n3", "source": "s9", "explanation": None}]
    got = {r.source: r for r in residue.validation(items(*rows)).collect()}
    assert set(got) == {"s0", "s4", "s9"}  # of s0 to s7 and s9, every fourth
    for s in got:
        parts = [c for r in rows if r["source"] == s and r["explanation"] for c in residue.clauses(r["explanation"])]
        v = got[s]
        assert (v.clauses, v.weak) == (len(parts), sum(bool(residue._WEAK.search(c)) for c in parts))
        assert v.agreed + v.missed == v.weak and v.extra <= v.clauses - v.weak


def test_every_weak_label_holds_a_trigger():
    automaton = residue._automaton()
    for t in [*RESIDUE, "Traceback (most recent call last): KeyError: 'a'", "<请在此输入解析内容>", "本题考查%s的内容", "______", "……………………", "xxx，xxx", "HTTP Status 500 - 请求的资源不可用", "SQLSTATE[HY000]: General error", "Access denied. Request id 1"]:
        assert any(residue._WEAK.search(c) for c in residue.clauses(t)) == residue.weak(t, automaton) is True, t


# ---- p3


def strip(x):
    import unicodedata

    return "".join(c for c in (x or "").lower() if unicodedata.category(c)[0] in "LN")


def test_format_duplicates_against_brute_force(items):
    rng, rows = random.Random(2), []
    for i in range(120):
        base = rng.randint(0, 40)
        texts = [f"选项{base}{k}" for k in "ABCDE"]
        rng.shuffle(texts)
        rows.append({"id": f"q{i:03d}", "stem": f" 题{base}，甲Ab？" if rng.random() < 0.5 else f"题{base}甲aB", "options": {k: rng.choice(["", " ", "【"]) + t + rng.choice(["", "。", " "]) for k, t in zip("ABCDE", texts)}})
    rows += [{"id": "anagram1", "stem": "甲乙", "options": {"A": "x"}}, {"id": "anagram2", "stem": "乙甲", "options": {"A": "x"}}, {"id": "z1", "stem": None, "options": None}, {"id": "z2", "stem": "", "options": {}}]
    first = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        first.setdefault((strip(r["stem"]), tuple(sorted(strip(v) for v in (r["options"] or {}).values()))), []).append(r["id"])
    want = {(g[0], x) for g in first.values() for x in g[1:]}
    q = items(*rows)
    assert {tuple(r) for r in format_dups.format_duplicates(q).collect()} == want
    kept = {r.id: r.copies for r in format_dups.deduplicated(q).select("id", "copies").collect()}
    assert kept == {g[0]: len(g) for g in first.values()}


# ---- p4


def test_page_lines_and_headers():
    for line in ("- 263 -", "第 12 页 共 680 页", "431/684", "P93", "Page 453 of 714", "[472]", "91", "— 121 —", "诊法学  历年卷 348", "第23章 经脉腧穴学考点精析", "Reedlake Review | 45", "CHAPTER 4  REVIEW OF THE LUNG"):
        assert edges.is_edge(line), line
    for line in ("1. 肝主疏泄。", "甲证与乙证之别，在于有无12", "肝主疏泄。", "故选A", "- 肝与胃相关，故口角颤动。", "【考点】", "（完）", "记忆提示："):
        assert not edges.is_edge(line), line


@pytest.mark.parametrize(
    ("text", "traced", "fixed"),
    [
        ("肝主疏\n泄。", True, "肝主疏泄。"), ("肝主疏泄。\n脾主运化。", False, None), ("1. 肝主疏泄。\n2. 脾主运化。", False, None), ("肝主 疏泄。", True, "肝主疏泄。"),
        ("肝主疏\n- 12 -\n泄。", True, "肝主疏泄。"), ("the stom-\nach hurts.", True, "the stomach hurts."), ("the sore\nthroat hurts.", True, "the sore" + scan_repair.JOINT + "throat hurts."),
        ("参见教材第12页。", False, None), ("X-ray检查。", False, None), ("取穴为\n某站 仅供学习", False, None), ("故选A\n有疑问请在评论区留言", False, None), ("故选A\n（完）", False, None),
    ],
)
def test_structure(text, traced, fixed):
    got = scan_repair.structure(text, {scan_repair._fold("某站 仅供学习")}, frozenset({truncation.line_key(" 有疑问请在评论区留言")}))
    assert got == (traced, fixed if fixed is not None else text)


def test_signs():
    assert scan_repair.signs("1l岁，7O例，证o肺") == (True, "11岁，70例，证。肺")
    assert scan_repair.signs("d!zz1ness at 5mg, O139, CO2, T-cell, 25.0mg") == (True, "dizzlness at 5mg, O139, CO2, T-cell, 25.0mg")
    assert scan_repair.signs("O139群与O型，CO2，30mg，Stage 5 of it") == (False, "O139群与O型，CO2，30mg，Stage 5 of it")


def test_misread_characters_and_words(items):
    rows = [{"id": f"a{i}", "stem": "头痛脉濡者，治宜宣散。", "explanation": "The patient shows dizziness of the kidney.", "options": {"A": "头痛"}} for i in range(80)]
    rows += [{"id": "m1", "stem": "头痛咏濡者，冶宜宣敬。", "explanation": "x", "options": {"A": "头通"}}, {"id": "m2", "stem": "x", "explanation": "The paticnt shows diz-\nziness of the kidncy.", "options": {}}]
    rows += [{"id": "j1", "stem": "x", "explanation": "The patient sho\n- 12 -\nws dizziness of\nthe kidney.", "options": {}}]
    rows += [{"id": f"p{i}", "stem": "疏通敬意", "explanation": None, "options": {}} for i in range(40)]
    got = {(r.id, r.field): r.repaired for r in scan_repair.repaired_fields(items(*rows)).collect()}
    assert set(got) == {("m1", "stem"), ("m2", "explanation"), ("m1", "option-A"), ("j1", "explanation")}
    assert got["j1", "explanation"] == "The patient shows dizziness of the kidney."
    assert got["m1", "stem"] == "头痛脉濡者，治宜宣散。" and got["m2", "explanation"] == "The patient shows dizziness of the kidney."


def test_broken_last_line_of_copies_is_joined(items, sentence):
    rows = [{"id": f"c{i}", "stem": "x", "explanation": sentence("b")[:-1] + "肝主疏\n泄气机而藏血液。", "options": {}, "source": f"s{i}"} for i in range(40)]
    got = {(r.id, r.field): r.repaired for r in scan_repair.repaired_fields(items(*rows)).collect()}
    assert got == {(r["id"], "explanation"): r["explanation"].replace("\n", "") for r in rows}


# ---- p5


def test_lookalike_classes_are_transitive():
    members, odd, _ = lookalike.classes()
    group = next(g for g in members.values() if "e" in g)
    assert {"ｅ", "е"} <= set(group) and "é" not in group
    assert {"é", "é"} <= set(next(g for g in members.values() if "é" in g))
    assert "①" not in odd and "℃" not in odd and "，" not in odd and "é" not in odd


def test_lookalikes(items):
    cases = {"c1": "肝​主", "c2": "甲　乙", "c3": "Ａ1", "c4": "café", "c5": "ЅОЅ", "c6": "⽤药", "c7": "DΝA", "c8": "\uf92e", "c9": "a\xa0b", "d1": "sοs"}
    fine = {"f1": "β受体与α受体，①℃μg", "f2": "（甲），。：！", "f3": "qì xū café", "f4": "plain text", "f5": "x≥0"}
    q = items(*({"id": k, "stem": v, "explanation": None} for k, v in (cases | fine).items()), {"id": "s", "stem": "x", "explanation": "y", "shared_options": {"B": "甲⁠乙", "A": None, "Z": "Ａ"}})
    got = {(r.id, r.field): r.consistent for r in lookalike.consistent_fields(q).collect()}
    assert set(got) == {(k, "stem") for k in cases} | {("s", "shared-option-B")}
    assert {k: got[k, "stem"] for k in cases} == {"c1": "肝主", "c2": "甲 乙", "c3": "A1", "c4": "café", "c5": "SOS", "c6": "用药", "c7": "DNA", "c8": "\u51b7", "c9": "a b", "d1": "sos"}
    every = {(r.id, r.field): r.text for r in lookalike.consistent_texts(q).collect()}
    assert every["f1", "stem"] == fine["f1"] and every["c3", "stem"] == "A1"


def test_frequency_chooses_among_usual_forms(items):
    """The micro sign or the Greek letter, whichever the texts hold more often; neither is a case."""
    for many, few in (("μ", "µ"), ("µ", "μ")):
        rows = [{"id": f"m{i}", "stem": f"5{many}g", "explanation": None} for i in range(3)] + [{"id": "f", "stem": f"7{few}g", "explanation": "Ａ-7‐9"}]
        q = items(*rows)
        every = {(r.id, r.field): r.text for r in lookalike.consistent_texts(q).collect()}
        assert every["f", "stem"] == f"7{many}g" and every["m0", "stem"] == f"5{many}g" and every["f", "explanation"] == "A-7-9"
        assert {(r.id, r.field) for r in lookalike.found(q).collect()} == {("f", "explanation")}
    members, odd, _ = lookalike.classes()
    several = [g for g in members.values() if len(set(g) - odd) > 1]
    assert len(several) >= len(lookalike.FORMS)


def test_every_odd_string_is_rewritten():
    """No odd string is left after the rewrite, so what is flagged and what is changed are one thing."""
    members, odd, near = lookalike.classes()
    to = {x: min((y for y in g if y not in odd), default=g[0]) for g in members.values() for x in g if x in odd}
    rewrite = lookalike.rewriter(to)
    for x in odd - near:
        new, case = rewrite("甲" + x + "乙")
        assert case and x not in new, x
    assert all(rewrite(x)[1] is False and rewrite(f"a{x}")[1] for x in near)


# ---- p6


def test_site_lines_against_brute_force(items):
    rng, rows = random.Random(6), []
    for i in range(150):
        s = rng.choice(["big", "big", "big", "small", None])
        lines = [f"行{rng.randint(0, 400)}"] + (["  某站   版权 "] if s == "big" and rng.random() < 0.2 else []) + (["页脚"] if rng.random() < 0.02 else []) + ["", "尾"][: rng.randint(0, 2)]
        rng.shuffle(lines)
        rows.append({"id": f"q{i:03d}", "source": s, "stem": "\n".join(lines), "explanation": rng.choice([None, "", "某站 版权", "他"])})
    norm = lambda x: " ".join(x.split())
    docs, totals = {}, {}
    for r in rows:
        totals[r["source"]] = totals.get(r["source"], 0) + 1
        for x in {norm(y) for t in (r["stem"], r["explanation"]) if t is not None for y in t.split("\n")} - {""}:
            docs.setdefault((r["source"], x), set()).add(r["id"])
    bad = {k for k, v in docs.items() if k[0] and len(v) >= 3 and 20 * len(v) >= totals[k[0]]}
    want = {(r["id"], f, n) for r in rows for f in ("stem", "explanation") if r[f] is not None for n, y in enumerate(r[f].split("\n"), 1) if (r["source"], norm(y)) in bad}
    q = items(*rows)
    assert {tuple(r) for r in site_lines.excessive_places(q).select("id", "field", "line_no").collect()} == want
    clean = {r.id: r for r in site_lines.without_site_lines(q).collect()}
    for r in rows:
        for f in ("stem", "explanation"):
            kept = None if r[f] is None else "\n".join(y for n, y in enumerate(r[f].split("\n"), 1) if (r["id"], f, n) not in want)
            assert getattr(clean[r["id"]], f) == kept


# ---- awkward inputs


OPERATORS = {
    "p1": truncation.found, "p1b": truncation.by_source, "p2": residue.found, "p2b": residue.without_residue, "p2v": residue.validation, "p3": format_dups.format_duplicates,
    "p3b": format_dups.deduplicated, "p4": scan_repair.found, "p5": lookalike.found, "p5b": lookalike.consistent_texts, "p6": site_lines.excessive_places, "p6b": site_lines.without_site_lines,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_tables(odd_bank, name):
    rows = OPERATORS[name](odd_bank).collect()
    assert OPERATORS[name](odd_bank.limit(0)).collect() == []
    if name in ("p1", "p2", "p4", "p5"):
        assert rows == []
    if name == "p3b":
        # the null and the empty record are one item; the repeated row is one record of an item with two
        assert {r.id: r.copies for r in rows} == {"e1": 2, "v1": 1, "r1": 2, "o1": 1}
    if name == "p6b":
        assert len(rows) == odd_bank.count()


def test_results_are_distinct(odd_bank):
    for name in ("p1", "p2", "p3", "p4", "p5", "p6"):
        rows = OPERATORS[name](odd_bank)
        assert rows.count() == rows.distinct().count()
