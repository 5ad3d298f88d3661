import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from itemweave.sources import documents, files, ocr, state, subject_text


def test_array_module(spark, tmp_path):
    rows = [{"id": "a", "stem": "甲]", "options": {"A": "x"}, "number": 1}, {"id": "b", "stem": None}]
    (tmp_path / "m.js").write_text("// x\nexport const QUESTIONS_9 = " + json.dumps(rows, ensure_ascii=False) + ";\n", encoding="utf-8")
    got = files.read_array_module(spark, str(tmp_path / "m.js"), "QUESTIONS_9").orderBy("bank_ord").collect()
    assert [(r.bank_ord, r.id, r.stem) for r in got] == [(0, "a", "甲]"), (1, "b", None)] and got[0].options == {"A": "x"}
    assert files.read_array_module(spark, str(tmp_path / "m.js"), "OTHER").count() == 0
    assert files.read_bank_module(spark, str(tmp_path / "m.js")).count() == 2
    (tmp_path / "two.js").write_text("export const QUESTIONS_1 = [];\nexport const QUESTIONS_2 = [];\n")
    (tmp_path / "main.js").write_text("export const QUESTIONS_1 = [];\nexport const QUESTIONS = [];\n")
    (tmp_path / "none.js").write_text("export const OTHER = [];\n")
    assert files.bank_name(spark, str(tmp_path / "main.js")) == "QUESTIONS"
    for name, why in (("two.js", "several"), ("none.js", "no bank")):
        with pytest.raises(files.ExportError, match=why):
            files.bank_name(spark, str(tmp_path / name))


def test_paths_stay_inside(items, tmp_path):
    assert files.inside("/a/b", "c/../d") == "/a/b/d"
    for path in ("../x", "/a/bc", "."):
        with pytest.raises(ValueError):
            files.inside("/a/b", path)
    with pytest.raises(ValueError):
        files.write_bank(items({}), "../out", root=str(tmp_path))


def test_version_depends_on_order_and_names(spark, items, monkeypatch):
    monkeypatch.setattr(files, "VERSION_BLOCK", 2)
    q = items(*({} for _ in range(5)))
    s = "subject_id string, ord int, source_name string, subject_name string"
    one = lambda rows, order=("number",), subs=(("x", 1, "f", "n"), ("y", 2, "g", "m")): files.bank_version(rows, spark.createDataFrame(list(subs), s), ["id", "stem"], list(order)).first().version
    base = one(q)
    assert len(base) == 16 and base == one(q.orderBy(F.desc("id"))) and base != one(q.withColumn("number", -F.col("number")))
    assert base not in (one(q.limit(4)), one(q, subs=(("x", 1, "f", "other"), ("y", 2, "g", "m"))), one(q, subs=(("x", 3, "f", "n"), ("y", 2, "g", "m"))))


def test_text_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.TXT").write_bytes("﻿甲\r\n乙".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.md").write_text("x")
    texts, failures = files.read_text_files(spark, str(tmp_path))
    assert [r.text for r in texts.collect()] == ["甲\n乙"] and [r.path[-5:] for r in failures.collect()] == ["b.txt"]
    assert texts.select(files.source_name()).first()[0] == "a"
    done = texts.select("path")
    assert files.pending(texts, done, "path").count() == 0


def test_write_and_fingerprint(spark, items, tmp_path):
    q = items({}, {})
    files.write_bank(q, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    cols = ["id", "stem"]
    assert back.count() == 2 and files.fingerprint(back, cols).first() == files.fingerprint(q, cols).first() != files.fingerprint(q.limit(1), cols).first()
    files.write_report(q.select("id"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def docx(*paras, numbering=""):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p>{'<w:pPr><w:numPr><w:ilvl w:val=%s/><w:numId w:val=%s/></w:numPr></w:pPr>' % ('\"0\"', '\"1\"') if n else ''}<w:r><w:t>{t}</w:t></w:r></w:p>" for t, n in paras)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f'<w:numbering {w}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
    return out.getvalue()


def test_word_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(("甲", True), ("", False), ("乙", False), ("丙", True)))
    (tmp_path / "b.docx").write_bytes(b"no")
    rows = documents.read_paragraphs(spark, str(tmp_path)).orderBy("path", "pos").collect()
    assert [(r.pos, r.text) for r in rows[:3]] == [(0, "3.甲"), (1, "乙"), (2, "4.丙")] and rows[3].pos == -1


def test_text_boxes_levels_and_noise():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    p = lambda t, level=None: "<w:p>" + (f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr></w:pPr>' if level is not None else "") + f"<w:r><w:t>{t}</w:t></w:r></w:p>"
    box = f"<w:p><w:r><w:t>outer </w:t></w:r><w:r><mc:AlternateContent><mc:Choice><w:txbxContent>{p('box')}</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>{p('box')}</w:txbxContent></mc:Fallback></mc:AlternateContent></w:r><w:r><w:t>end</w:t></w:r></w:p>"
    body = box + p("a", 0) + p("b", 1) + p("c", 1) + p("d", 0) + p("e", 1) + p("www.x.y 1") + "<w:tbl><w:tr><w:tc>" + p("cell") + "</w:tc></w:tr></w:tbl>"
    level = lambda n, kind, label: f'<w:lvl w:ilvl="{n}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{label}"/></w:lvl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f'<w:numbering {w}><w:abstractNum w:abstractNumId="0">{level(0, "upperRoman", "%1.")}{level(1, "lowerLetter", "%1.%2)")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
    assert documents.paragraphs(out.getvalue(), r"www") == ["outer end", "box", "I.a", "I.a)b", "I.b)c", "II.d", "II.a)e", "cell"]


def test_scanned_lines(spark, tmp_path):
    page = {"source": "s", "kind": "k", "dpi": 200, "records": [{"page": 1, "column": 1, "row": 1, "lines": ["甲 乙", "www.x.com", "丙"]}, {"page": 1, "column": 1, "row": 2, "lines": ["丙", "丁", "Ａ"]}]}
    (tmp_path / "o.json").write_text(json.dumps(page, ensure_ascii=False), encoding="utf-8")
    lines = ocr.clean_lines(ocr.read_pages(spark, str(tmp_path / "o.json")), ["WWW."])
    assert [(r.row, r.text) for r in lines.orderBy("row", "line").collect()] == [(1, "甲乙"), (1, "丙"), (2, "丁"), (2, "A")]
    df = spark.createDataFrame([("p012-c3-r2.txt",), ("p001-c1.txt",)], "n string")
    assert [tuple(r) for r in df.select(*ocr.tile_of(F.col("n"))).collect()] == [(12, 3, 2), (1, 1, 1)]


OPTIONS = "\n".join(f"{k}. {k}项" for k in "ABCDE")


def test_subject_file_with_groups():
    text = "﻿" + "\r\n".join(
        ["1. 单题", *OPTIONS.split("\n"), "正确答案：A", "解析：一", "续行", "", "(2~3)共用选项", *OPTIONS.split("\n"), "2. 甲问", "3. 乙问", "正确答案：(2)B (3)C", "解析：二", "",
         "(4~5)共用题干单选", "病例", "4. 丙问", *OPTIONS.split("\n"), "正确答案：D", "解析：三", "", "5. 丁问", *OPTIONS.split("\n"), "正确答案：E", "解析：四"]
    )
    kept, issues = subject_text.parse(text, "某科题")
    assert [x["type"] for x in kept] == ["A1/A2", "B1", "B1", "A3", "A3"] and not issues
    assert kept[0]["explanation"] == "一\n续行" and [x["answer"] for x in kept] == list("ABCDE")
    assert kept[3]["stem"] == "病例 丙问" and (kept[1]["group_start"], kept[1]["group_end"]) == (2, 3)


def test_subject_file_with_matching_children_and_faults():
    text = "\n".join(["2.【配伍题】", *OPTIONS.split("\n"), "(1) 甲", "(2) 乙", "正确答案：(1)A (2)B", "解析：同"])
    kept, issues = subject_text.parse(text, "某科题")
    assert [x["id"][-8:] for x in kept][1] == "0001-S02" and not issues and [x["source_sub_question_number"] for x in kept] == [1, 2]
    kept, issues = subject_text.parse("(1~2)共用选项\n" + OPTIONS + "\n1. 甲\n正确答案：\n解析：无", "某科题")
    assert not kept and {x["code"] for x in issues} == {"missing-answer", "group-range-mismatch"}
    kept, issues = subject_text.parse("正确答案：A", "某科题")
    assert not kept and [x["code"] for x in issues] == ["orphan-answer"]
    assert subject_text.parse("", "某科题") == ([], [])
    kept, _ = subject_text.parse("一、\n无号题干\n" + OPTIONS + "\n正确答案：B\n解析：有", "某科题")
    assert kept[0]["source_section_number"] == 1 and kept[0]["stem"] == "无号题干"


def test_subject_files_as_tables(spark):
    df = spark.createDataFrame([("p", "某科题", "1. 单题\n" + OPTIONS + "\n正确答案：A\n解析：一"), ("q", "空", "")], "path string, name string, text string")
    kept, issues = subject_text.parse_files(df)
    assert kept.count() == 1 and kept.first().options["E"] == "E项" and issues.count() == 0


def test_state_records_and_backup(spark):
    one = json.dumps({"sessions": {"a": {"id": "a", "version": 2, "updatedAt": "t"}, "b": {"version": 1}}, "wrongs": {"w": {"questionId": "q"}}, "settings": {"passwordHash": "secret"}})
    df = spark.createDataFrame([("d", one)], "device string, state string")
    assert {(r.collection, r.key, r.version) for r in state.records(df).collect()} == {("sessions", "a", 2), ("wrongs", "q", None)}
    out = df.select(state.redacted(F.col("state")).alias("b")).first().b
    assert "secret" not in out and json.loads(out)["state"]["settings"] == {}
    odd = json.dumps({"sync": {"passwordHash": 'ab"cd', "code": "x"}, "a": 'passwordHash":"q', "l": [1], "n": None})
    out2 = spark.createDataFrame([(odd,)], "s string").select(state.redacted(F.col("s")).alias("b")).first().b
    assert json.loads(out2)["state"] == {"sync": {"code": "x"}, "a": 'passwordHash":"q', "l": [1], "n": None}
    assert spark.createDataFrame([(out,), ("{}",)], "b string").select(state.valid_backup(F.col("b"))).collect() == [(True,), (False,)]
