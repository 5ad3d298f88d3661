"""Queries over literal inputs, for operators whose inputs are no tables: files, scans, readings, states, corrections.

Each query states its input rows and the rows it has to give; the SQL is those rows.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemweave.functions import text as X
from itemweave.operators import bank, events, fusion, lookup, merge, paper, patches, quality, scanned_bank, sequence, sessions, validate
from itemweave.schema import ITEM, LETTERS
from itemweave.session import _path, scratch_dir, written
from itemweave.sources import documents, files, ocr, papers, state, subject_text
from itemweave.streaming.mistakes import step

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_KINDS = {"string": "varchar", "int": "integer", "long": "bigint", "double": "double", "boolean": "boolean"}


def _value(v) -> str:
    return "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower()


def _gives(schema: str, *rows: tuple):
    """Register a function of the session as the query of its name, with the rows it has to give."""
    columns = [c.split() for c in schema.split(", ")]

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        cast = ", ".join(f"cast({n} as {_KINDS[k]}) as {n}" for n, k in columns)
        SQL[f.__name__] = f"select {cast} from (values {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) t({', '.join(n for n, _ in columns)})"
        return f

    return register


def _table(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _folder(spark: SparkSession, **content: bytes | str) -> str:
    """A new folder below the shared scratch folder with the files given; __ stands for a point in a name."""
    root = f"{scratch_dir(spark)}/itemweave-literal-{uuid.uuid4().hex}"
    for name, data in content.items():
        system, path = _path(spark, f"{root}/{name.replace('__', '.')}")
        out = system.create(path, True)
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
        out.close()
    return root


_MORE = [T.StructField("source", T.StringType()), T.StructField("subject_id", T.StringType()), T.StructField("bank_ord", T.IntegerType()), T.StructField("source_sub_question_number", T.IntegerType())]


def _items(spark: SparkSession, *rows: dict) -> DataFrame:
    """Items of the year 2099; what a row leaves out gets a plain value."""
    out = []
    for n, r in enumerate(rows):
        base = {"id": f"2099-U1-{n + 1:03d}", "unit": 1, "number": n + 1, "type": "A1/A2", "stem": f"题干{n}", "options": {k: f"{k}项{n}" for k in LETTERS}, "answer": "A", "explanation": f"正文{n}。", "source": "s", "subject_id": "x", "bank_ord": n}
        out.append(base | r)
    return spark.createDataFrame(out, T.StructType(ITEM.fields + _MORE))


# ---- question files of subjects


_OPTIONS = "\n".join(f"{k}. {k}项" for k in LETTERS)
_SUBJECT = {
    "groups": "﻿" + f"1. 单题\n{_OPTIONS}\n正确答案：A\n解析：一\n续行\n\n(2~3)共用选项\n{_OPTIONS}\n2. 甲问\n3. 乙问\n正确答案：(2)B (3)C\n解析：二\n\n(4~5)共用题干单选\n病例\n4. 丙问\n{_OPTIONS}\n正确答案：D\n解析：三\n\n5. 丁问\n{_OPTIONS}\n正确答案：Ｅ\n解析：四".replace("\n", "\r\n"),
    "matching": f"2.【配伍题】\n{_OPTIONS}\n(1) 甲\n(2) 乙\n正确答案：(1)A (2)B\n解析：同",
    "section": f"十二、\n无号题干\n{_OPTIONS}\n正确答案：B\n解析：有\n\n（全文完）",
    "broken": f"(1~2)共用选项\n{_OPTIONS}\n1. 甲\n正确答案：\n解析：无",
    "orphan": "正确答案：A",
}


def _subject_files(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return subject_text.parse_files(_table(spark, "path string, name string, text string", *((p, "某科题", t) for p, t in _SUBJECT.items())))


@_gives(
    "path string, tail string, type string, stem string, answer string, explanation string, first int, last int, part int",
    ("groups", "0001", "A1/A2", "单题", "A", "一\n续行", None, None, None), ("groups", "0002", "B1", "甲问", "B", "二", 2, 3, None), ("groups", "0003", "B1", "乙问", "C", "二", 2, 3, None),
    ("groups", "0004", "A3", "病例 丙问", "D", "三", 4, 5, None), ("groups", "0005", "A3", "病例 丁问", "E", "四", 4, 5, None),
    ("matching", "0001", "B1", "甲", "A", "同", 1, 2, 1), ("matching", "0001-S02", "B1", "乙", "B", "同", 1, 2, 2), ("section", "0001", "A1/A2", "无号题干", "B", "有", None, None, None),
)
def subject_file_items(spark):
    rows, _ = _subject_files(spark)
    tail = F.regexp_extract("id", r"(\d{4}(?:-S\d+)?)$", 1)
    return rows.select("path", tail.alias("tail"), "type", "stem", "answer", "explanation", F.col("group_start").alias("first"), F.col("group_end").alias("last"), F.col("source_sub_question_number").alias("part"))


@_gives("path string, code string", ("broken", "missing-answer"), ("broken", "group-range-mismatch"), ("orphan", "orphan-answer"))
def subject_file_issues(spark):
    return _subject_files(spark)[1].select("path", "code").distinct()


# ---- papers and answer sheets


_PAPER = [
    "第一单元", "A1/A2型题", "1. 单题题干", "A. 甲 B. 乙 C. 丙", "D. 丁 E. 戊", "答案：C", "解析：因为丙。2．粘连题 A. 一 B. 二 C. 三 D. 四 E. 五 答案：A", "A3/A4型题",
    "共用题干：患者腹痛", "3. 首问", "A. a B. b C. c D. d E. e", "4. 次问", "A. f B. g C. h D. i E. j", "B型题", "（5～6题共用备选答案）", "A. 甲 B. 乙", "C. 丙 D. 丁 E. 戊",
    "5. 问五", "答案：B", "6. 问六 剂量13.5克",
]


@_gives(
    "id string, type string, stem string, b string, answer string, explanation string, shared_stem string, shared_d string, first int, last int",
    ("2024-U1-001", "A1/A2", "单题题干", "乙", "C", "因为丙。", None, None, None, None), ("2024-U1-002", "A1/A2", "粘连题", "二", "A", "", None, None, None, None),
    ("2024-U1-003", "A3", "患者腹痛 首问", "b", None, "", "患者腹痛", None, 3, 4), ("2024-U1-004", "A3", "患者腹痛 次问", "g", None, "", "患者腹痛", None, 3, 4),
    ("2024-U1-005", "B1", "问五", "乙", "B", "", None, "丁", 5, 6), ("2024-U1-006", "B1", "问六 剂量13.5克", "乙", None, "", None, "丁", 5, 6),
)
def paper_items(spark):
    rows = papers.parse_papers(_table(spark, "paper string, year int, pos int, text string", *(("p", 2024, n, t) for n, t in enumerate(_PAPER))))
    return rows.select(
        "id", "type", "stem", F.try_element_at("options", F.lit("B")).alias("b"), "answer", "explanation", "shared_stem", F.try_element_at("shared_options", F.lit("D")).alias("shared_d"),
        F.col("group_start").alias("first"), F.col("group_end").alias("last"),
    )


@_gives("paper string, number int, answer string, explanation string", ("p", 1, "A", "甲。 续"), ("p", 2, "B", "2. 乙文"), ("p", 3, "C", "略"))
def paper_answers(spark):
    lines = ["【答案】A【解析】甲。", "续", "2.", "乙文", "答案：C 略"]
    return papers.parse_answers(_table(spark, "paper string, pos int, text string", *(("p", n, t) for n, t in enumerate(lines))), {2: "B"})


# ---- scanned pages


_SCAN = {
    "source": "s", "kind": "k", "dpi": 200,
    "records": [
        {"page": 1, "column": 1, "row": 1, "lines": ["甲 乙", "www.x.com", "丙"]}, {"page": 1, "column": 1, "row": 2, "lines": ["丙", "丁", "Ａ"]},
        {"page": 1, "column": 2, "row": 1, "lines": ["丙", " ", "戊"]},
    ],
}


@_gives("page int, col int, row int, line int, text string", (1, 1, 1, 1, "甲乙"), (1, 1, 1, 3, "丙"), (1, 1, 2, 2, "丁"), (1, 1, 2, 3, "A"), (1, 2, 1, 1, "丙"), (1, 2, 1, 3, "戊"))
def scanned_lines(spark):
    """Pages of a nested file as lines: folded, without noise, blank lines and the overlap of tiles."""
    folder = _folder(spark, o__json=json.dumps(_SCAN, ensure_ascii=False))
    return ocr.clean_lines(ocr.read_pages(spark, folder), ["WWW."]).withColumnRenamed("column", "col")


@_gives("name string, page int, col int, row int", ("a/p012-c3-r2.txt", 12, 3, 2), ("p001-c1.txt", 1, 1, 1), ("x.txt", None, None, 1))
def scanned_tiles(spark):
    names = _table(spark, "name string", ("a/p012-c3-r2.txt",), ("p001-c1.txt",), ("x.txt",))
    return names.select("name", *ocr.tile_of(F.col("name"))).withColumnRenamed("column", "col")


def _scan_lines(spark: SparkSession, *texts: str) -> DataFrame:
    return _table(spark, "paper string, page int, column int, row int, line int, text string", *(("p", 1, 1, 1, n, t) for n, t in enumerate(texts)))


@_gives("entry long, number int, answer string, explanation string", (1, 1, "A", "一续一"), (2, 2, "B", ""), (3, 3, "C", "三"))
def scanned_answers(spark):
    """Answer lines of a paper with the lines after them; a number may stand on a line of its own before."""
    return scanned_bank.answer_entries(_scan_lines(spark, "前言", "1.【答案】A", "解析一", "续一", "2.", "【答案】B", "3.答案C", "解析三"), ["paper"]).select("entry", "number", "answer", "explanation")


@_gives("set_no int, context string, options string, missing string", (1, "1.题干", "甲|乙续|丙|丁|戊", ""), (2, "2.题", "甲甲|乙||丁|戊", "C"), (3, "", "单||||", "BCDE"))
def scanned_option_sets(spark):
    """Runs of options: F read for E, a first option without its letter, a skipped letter."""
    rows = scanned_bank.option_sets(_scan_lines(spark, "1.题干", "A.甲", "B.乙", "续", "C.丙", "D.丁", "F.戊", "2.题", "甲甲", "B.乙", "D.丁", "E.戊", "A.单"), ["paper"])
    texts = F.array_join(F.transform(F.array(*(F.lit(k) for k in LETTERS)), lambda k: F.try_element_at("options", k)), "|")
    return rows.select("set_no", F.array_join("context", "|").alias("context"), texts.alias("options"), F.array_join("missing", "").alias("missing"))


_PAGE = [
    "第一单元", "1.甲问", "续甲", "A.一", "B.二", "C.三", "D.四", "E.五", "（2～3题共用题干）", "共用题干：病例文", "某水印", "2.乙问", "A.a", "B.b", "C.c", "D.d", "E.e", "3.丙问", "A.f", "B.g", "C.h", "D.i", "E.j",
    "（5～6题共用备选答案）", "A.甲", "B.乙", "C.丙", "D.丁", "E.戊", "5.戊问", "续戊", "6.己问", "（7～8题共用备选答案）",
]


@_gives(
    "number int, set_first int, prompt string, shared_stem string, b string",
    (1, 1, "甲问续甲", "", "二"), (2, 2, "乙问", "病例文", "b"), (3, 3, "丙问", "", "g"), (4, 4, "", "", None), (5, 5, "戊问续戊", "", "乙"), (6, 5, "己问", "", "乙"),
)
def scanned_questions(spark):
    """Option sets aligned with the expected numbers (4 is missing), with their questions and shared stems."""
    wanted = _table(spark, "paper string, type string, number int, set_first int", ("p", "A1/A2", 1, 1), ("p", "A3", 2, 2), ("p", "A3", 3, 3), ("p", "A1/A2", 4, 4), ("p", "B1", 5, 5), ("p", "B1", 6, 5))
    rows = scanned_bank.read_sets(_scan_lines(spark, *_PAGE), wanted, ["paper"], ("某水印",))
    return rows.select("number", "set_first", "prompt", "shared_stem", F.try_element_at("options", F.lit("B")).alias("b"))


@_gives(
    "number int, set_first int, group_id string",
    (1, 1, None), (2, 2, None), (3, 3, "2021-U1-B1-003-004"), (4, 3, "2021-U1-B1-003-004"), (5, 5, "2021-U1-B1-005-006"), (6, 5, "2021-U1-B1-005-006"), (7, 7, "2021-U1-B1-007-007"),
)
def scanned_layout(spark):
    ranges = _table(spark, "year int, unit int, type string, first int, last int, size int", (2021, 1, "A1/A2", 1, 2, 1), (2021, 1, "B1", 3, 7, 2))
    return scanned_bank.layout(ranges).select("number", "set_first", "group_id")


@_gives("first int, last int, kind string, number int", (2, 4, "A3", 2), (2, 4, "A3", 3), (2, 4, "A3", 4), (7, 8, "B1", 7), (7, 8, "B1", 8))
def scanned_ranges(spark):
    return scanned_bank.range_members(_scan_lines(spark, "(2～4题共用题干)", "正文", "（7-8题共用备选答秦）", "（9～8题共用题干）"))


@_gives("n int, unit string, segment long", (1, None, 0), (2, "a", 1), (3, "a", 1), (4, "b", 2))
def carried_values(spark):
    rows = _table(spark, "paper string, n int, unit string", ("p", 1, None), ("p", 2, "a"), ("p", 3, None), ("p", 4, "b"))
    cut = scanned_bank.segments(rows, ["paper"], ["n"], F.col("unit").isNotNull())
    return scanned_bank.carried(cut, ["paper"], ["n"], ["unit"]).select("n", "unit", "segment")


_SPOKEN = [
    (1, "12.【解析】选AO再看。13.患者"), (2, "旧解析】新。甲 【2】乙；"), (3, "【解析】略"), (4, "12"), (5, "剂量13.5克，证属I)O"), (6, None),
]


@_gives(
    "n int, stopped string, own string, plain string, missing boolean",
    (1, "12.【解析】选A。再看。13.患者", "选AO再看。", "选AO再看。13.患者", False), (2, "旧解析】新。甲 【2】乙；", "旧解析】新。甲 【2】乙；", "新。甲乙", False), (3, "【解析】略", "【解析】略", "略", True),
    (4, "12", "12", "12", True), (5, "剂量13.5克，证属D。", "剂量13.5克，证属I)O", "剂量13.5克，证属I)O", False), (6, None, "", "", True),
)
def scanned_explanations(spark):
    t = F.col("t")
    rows = _table(spark, "n int, t string", *_SPOKEN)
    own = scanned_bank.without_anchor(t, F.lit(12), F.lit(13))
    return rows.select("n", scanned_bank.restored_stops(t).alias("stopped"), own.alias("own"), scanned_bank.plain_explanation(t).alias("plain"), scanned_bank.is_missing(t).alias("missing"))


@_gives("n int, one string, two string, about string", (1, "丁戊", "丙", "丙"), (2, None, None, "丙证用丁"), (3, "甲", None, "甲"))
def explanation_parts(spark):
    """What a combined explanation says about its members, and its sentences about an answer."""
    rows = _table(spark, "n int, t string, a string", (1, "前【1】甲；乙。【2】丙。【1】丁 戊", "丙"), (2, "甲证用乙。丙证用丁。", "丁"), (3, "【1】甲【3】。", None))
    parts = scanned_bank.group_parts(F.col("t"))
    return rows.select("n", F.try_element_at(parts, F.lit(1)).alias("one"), F.try_element_at(parts, F.lit(2)).alias("two"), scanned_bank.focused(F.col("t"), F.col("a")).alias("about"))


@_gives("id string, explanation string", ("2099-U1-001", "甲。"), ("2099-U1-002", "乙。"), ("2099-U1-005", "B项4为是。"), ("2099-U1-006", "A项5为非。"))
def dealt_explanations(spark):
    """Combined explanations dealt out by member number, or by the answer's text; groups with several texts stay."""
    g, h, k = ({"type": "B1", "group_id": x} for x in "ghk")
    same = "B项4为是。A项5为非。"
    rows = _items(spark, g | {"explanation": "【1】甲。【2】乙。"}, g | {"explanation": "原文件未提供解析。"}, h | {"explanation": "独一。"}, h | {"explanation": "独二。"}, k | {"answer": "B", "explanation": same}, k | {"explanation": same})
    return scanned_bank.distributed_explanations(rows)


def _built(spark: SparkSession):
    layout = _table(spark, "paper string, type string, number int, set_first int", ("p", "A1/A2", 1, 1), ("p", "A3", 2, 2), ("p", "A3", 3, 3), ("p", "A1/A2", 4, 4), ("p", "B1", 5, 5), ("p", "B1", 6, 5))
    layout = layout.withColumn("group_id", F.when(F.col("type") == "A3", "g"))
    other = [{"C.三": "C.散三三散", "B.乙": "B.乙", "1.甲问": "1.甲问甲问甲问甲问甲问"}.get(t, t) for t in _PAGE if t != "A.一"]
    keys = _table(spark, "paper string, number int, answer string", ("p", 1, "A"), ("p", 2, "B"), ("p", 3, "C"), ("p", 4, "D"), ("p", 5, "E"), ("p", 6, None))
    return scanned_bank.build_papers([_scan_lines(spark, *_PAGE), _scan_lines(spark, *other)], layout, keys, ["paper"], ("某水印",))


@_gives("number int, prompt string, shared_stem string, c string, answer string", (1, "甲问续甲", None, "三", "A"), (2, "乙问", "病例文", "c", "B"), (3, "丙问", "病例文", "h", "C"), (5, "戊问续戊", None, "丙", "E"))
def built_papers(spark):
    """Items of a paper that was read twice; 4 was not found and 6 has no answer."""
    return _built(spark)[0].select("number", "prompt", "shared_stem", F.try_element_at("options", F.lit("C")).alias("c"), "answer")


@_gives("number int, reason string", (4, "field"), (6, "answer"))
def built_exclusions(spark):
    return _built(spark)[1].select("number", "reason")


@_gives("number int, field string, ratio double", (1, "option-A", 0.0), (1, "option-C", 0.4), (1, "prompt", 0.429))
def built_disagreements(spark):
    """The second reading lost its first option, so it took the line before, and read two texts differently."""
    return _built(spark)[2].select("number", "field", "ratio")


@_gives("n int, clean string", (1, "女子之病"), (2, "正文"), (3, "5mmol，完。"))
def cleaned_by_default(spark):
    rows = _table(spark, "n int, t string", (1, "女于之病。12.一点笔记"), (2, "正文<第12页>以后"), (3, "5mmo1，完。 45."))
    return rows.select("n", scanned_bank.rewritten(F.col("t")).alias("clean"))


@_gives("n int, clean string", (1, "甲子之病"), (2, "正文"), (3, "完。"), (4, ""))
def cleaned_texts(spark):
    rows = _table(spark, "n int, t string", (1, "甲于之病。12.某水印"), (2, "正文第12页以后"), (3, "完。 45."), (4, None))
    return rows.select("n", scanned_bank.rewritten(F.col("t"), {"甲于": "甲子"}, ["某水印"], ["第[^页]{0,8}页"]).alias("clean"))


# ---- scalar functions


@_gives(
    "t string, letter string, numeral int, first int, answers string",
    ("ｂ", "Ｂ", None, None, None), ("Ｃ", "C", None, None, "0:C"), ("四十二", "四十二", 42, None, None), ("百", "百", 100, None, None), ("十", "十", 10, None, None), ("I2.x", "I2.X", None, 12, None),
    ("(2)A (3) B 2.C", "(2)A (3) B 2.C", None, 2, "2:C,3:B"), ("&0、d", "&0、D", None, 80, "0:D"), ("7", "7", None, 7, None), ("二", "二", 2, None, None),
)
def letters_and_numerals(spark):
    """Answer letters, Chinese numerals, numbers as a scanner reads them, and answers by number."""
    rows = _table(spark, "t string", *((x,) for x in ("ｂ", "Ｃ", "四十二", "百", "十", "I2.x", "(2)A (3) B 2.C", "&0、d", "7", "二")))
    t = F.col("t")
    found = F.array_join(F.array_sort(F.transform(F.map_entries(X.answers_of_line(t)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"]))), ",")
    return rows.select("t", X.answer_letter(t).alias("letter"), X.chinese_number(t).alias("numeral"), X.scanned_number(t).alias("first"), found.alias("answers"))


@_gives("a string, b string, chosen string, ratio double", (" 甲乙丙丁", "甲乙丙戊", "甲乙丙丁", 0.6667), (" ", "补", "补", 0.0), (None, "甲", "甲", None), ("abcd", "bcde", "abcd", 0.75))
def chosen_texts(spark):
    rows = _table(spark, "a string, b string", (" 甲乙丙丁", "甲乙丙戊"), (" ", "补"), (None, "甲"), ("abcd", "bcde"))
    return rows.select("a", "b", fusion.choose_text(F.col("a"), F.col("b")).alias("chosen"), F.round(X.match_ratio("a", "b"), 4).alias("ratio"))


@_gives("code string, hash string, version int", ("3U2YB-BSLDN", "138bca265399a4cd1ca8a6866916938abc9b008ec6a8f2f7d384b270a3d7bd4f", 3))
def sync_values(spark):
    rows = _table(spark, "seed string, v int", ("seed", 2))
    return rows.select(lookup.sync_code(F.col("seed")).alias("code"), lookup.sync_hash(F.lit("ABCDE-FGHJK"), F.lit("secret")).alias("hash"), lookup.next_version(F.col("v")).alias("version"))


# ---- files and states


@_gives("name string, bank_ord int, id string, a string", ("QUESTIONS_9", 0, "a", "x"), ("QUESTIONS_9", 1, "b", None))
def module_items(spark):
    rows = [{"id": "a", "stem": "甲]", "options": {"A": "x"}}, {"id": "b", "stem": None}]
    path = _folder(spark, m__js="// x\nexport const VERSION = 1;\nexport const QUESTIONS_9 = " + json.dumps(rows, ensure_ascii=False) + ";\n")
    return files.read_bank_module(spark, path).select(F.lit(files.bank_name(spark, path)).alias("name"), "bank_ord", "id", F.try_element_at("options", F.lit("A")).alias("a"))


def _texts(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return files.read_text_files(spark, _folder(spark, **{"d/a__TXT": "﻿甲\r\n乙".encode(), "b__txt": b"\xff\xfe\x00", "c__md": b"x", "C__txt": b"z"}))


@_gives("file_no long, name string, text string", (1, "C", "z"), (3, "a", "甲\n乙"))
def text_files(spark):
    return _texts(spark)[0].select("file_no", files.source_name().alias("name"), "text")


@_gives("name string", ("b",))
def text_file_failures(spark):
    return _texts(spark)[1].select(files.source_name().alias("name"))


@_gives("year int, id string, stem string, pending boolean", (2098, "2098-U1-001", "题干0", False), (2099, "2099-U1-002", "题干1", True))
def bank_round_trip(spark):
    """A bank written by year below a root and read again, and which of its items still lack a record."""
    root = f"{scratch_dir(spark)}/itemweave-literal-{uuid.uuid4().hex}"
    files.write_bank(_items(spark, {"id": "2098-U1-001"}, {}), "out", root)
    files.write_report(_table(spark, "id string", ("2098-U1-001",)), f"{root}/report")
    back, done = files.read_bank(spark, f"{root}/out"), spark.read.json(f"{root}/report")
    left = files.pending(back, done, "id").select("id", F.lit(True).alias("left"))
    return back.join(left, "id", "left").select("year", "id", "stem", F.coalesce("left", F.lit(False)).alias("pending"))


_STATE = {
    "sessions": {"a": {"id": "a", "version": 2, "updatedAt": "t"}, "b": {"version": 1}}, "wrongs": {"w": {"questionId": "q"}}, "sync": {"code": "c", "passwordHash": 'ab"cd'},
    "wrongBook": {"version": 1, "entries": {"q": {"questionId": "q", "sources": {"review": True}, "wrongCount": 0, "correctAt": "t"}, "r": {"questionId": "other"}, "s": {"questionId": "s", "correctInWrongBook": True, "correctAt": "u", "wrongCount": 3}}},
}


def _states(spark: SparkSession) -> DataFrame:
    old = {"wrongBook": {"version": 9, "entries": {"q": {"questionId": "q"}}}}
    return _table(spark, "device string, state string", ("d", json.dumps(_STATE)), ("e", json.dumps(old)))


@_gives("device string, collection string, key string, version int, updated_at string", ("d", "sessions", "a", 2, "t"), ("d", "wrongs", "q", None, None))
def state_records(spark):
    return state.records(_states(spark)).select("device", "collection", "key", "version", "updated_at")


@_gives("device string, hidden boolean, code string, valid boolean", ("d", True, "c", True), ("e", True, None, True))
def state_backups(spark):
    b = F.col("backup")
    rows = _states(spark).select("device", state.redacted(F.col("state")).alias("backup"))
    return rows.select("device", (~b.contains("cd") & ~b.contains("passwordHash")).alias("hidden"), F.get_json_object(b, "$.state.sync.code").alias("code"), state.valid_backup(b).alias("valid"))


@_gives("question_id string, review boolean, exam boolean, wrong_count int, correct_in_book boolean, correct_at string", ("q", True, False, 1, False, None), ("s", False, False, 3, True, "u"))
def state_book(spark):
    return state.book_entries(_states(spark)).drop("device")


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, level=None: "<w:p>" + (f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr></w:pPr>' if level is not None else "") + f"<w:r><w:t>{t}</w:t></w:r></w:p>"
    box = f"<w:p><w:r><w:t>外框</w:t></w:r><w:r><w:txbxContent>{p('内框')}</w:txbxContent></w:r></w:p>"
    body = box + p("甲", 0) + p("乙", 1) + p("丙", 1) + p("丁", 0) + p("戊", 1) + p("某站 1") + "<w:tbl><w:tr><w:tc>" + p("格") + "</w:tc></w:tr></w:tbl>"
    level = lambda n, kind, label: f'<w:lvl w:ilvl="{n}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{label}"/></w:lvl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f'<w:numbering {w}><w:abstractNum w:abstractNumId="0">{level(0, "decimal", "%1.")}{level(1, "upperLetter", "%1.%2)")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
    return out.getvalue()


@_gives("pos int, text string", (0, "外框"), (1, "内框"), (2, "1.甲"), (3, "1.A)乙"), (4, "1.B)丙"), (5, "2.丁"), (6, "2.A)戊"), (7, "格"), (-1, "BadZipFile"))
def word_paragraphs(spark):
    """Paragraphs of word files with numbers of several levels, a text box and a table, and a file that is none."""
    rows = documents.read_paragraphs(spark, _folder(spark, a__docx=_docx(), b__docx=b"no"), "^某站")
    return rows.select("pos", F.when(F.col("pos") < 0, F.split_part("text", F.lit("("), F.lit(1))).otherwise(F.col("text")).alias("text"))


# ---- joins, corrections, evidence


@_gives("id string, status string", ("2099-U1-001", "ok"), ("2099-U1-002", "changed"), ("2099-U1-003", "no-marker"), ("none", "unknown-id"), ("2099-U1-004", "ok"), ("2099-U1-004", "duplicate"))
def backfill_status(spark):
    rows = [(f"2099-U1-00{n}", b, a) for n, b, a in ((1, "正文0。", "新（补）"), (2, "别的", "新（补）"), (3, "正文2。", "新"), (4, "正文3。", "新（补）"), (4, "正文3。", "更新（补）"))]
    fills = _table(spark, "id string, before string, after string", *rows, ("none", "x", "y（补）"))
    return patches.backfill_status(_items(spark, {}, {}, {}, {}), fills, "（补）").select("id", "status")


_NUMBERED = "id string, subject_id string, source_question_number int, number int, options map<string,string>, shared_options map<string,string>"
_FIXES = "correction_id string, subject_id string, source_question_number int, letter string, before string, after string, expected_ids array<string>"


def _corrections(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, _NUMBERED, ("a", "s", 5, 1, {"A": "x", "B": "w"}, {"A": "x"}), ("b", "s", 5, 2, {"A": "x"}, None), ("c", "s", 6, 3, {"A": "y"}, None))
    return rows, _table(spark, _FIXES, ("1", "s", 5, "A", "x", "z", ["a", "b"]), ("2", "s", 5, "A", "x", "v", ["b", "a"]), ("3", "s", 6, "A", "x", "z", ["c"]), ("4", "s", 9, "A", "x", "z", ["d"]))


@_gives("correction_id string, status string", ("1", "ok"), ("2", "other-items"), ("3", "changed"), ("4", "other-items"))
def correction_status(spark):
    return lookup.corrected_options(*_corrections(spark))


@_gives("id string, a string, b string, shared string", ("a", "z", "w", "z"), ("b", "z", None, None), ("c", "y", None, None))
def corrected_items(spark):
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    return lookup.corrected(*_corrections(spark), strict=False).select("id", at("options", "A").alias("a"), at("options", "B").alias("b"), at("shared_options", "A").alias("shared"))


@_gives("id string, source_ids string, organizations long, corroborated boolean", ("q", "s2,s1,s3", 2, True), ("r", "s1", 1, False))
def evidence_links(spark):
    fills, given = _table(spark, "id string", ("q",), ("r",)), _table(spark, "id string, source_ids array<string>", ("q", ["s2", "s1", "s3"]), ("r", ["s1"]))
    rows = lookup.evidence(fills, given, _table(spark, "source_id string, organization string", ("s1", "o"), ("s2", "p"), ("s3", "o")))
    return rows.select("id", F.array_join("source_ids", ",").alias("source_ids"), "organizations", "corroborated")


@_gives("id string", ("a",), ("c",))
def undisputed_backfills(spark):
    disputes = _table(spark, "id string", ("b",), ("b",), ("d",))
    open_ = lookup.undisputed(_table(spark, "id string", ("a",), ("b",), ("c",)), disputes)
    return lookup.settled(open_, disputes, 2)


@_gives("id string, answer string, explanation string, next string", ("2099-U1-001", "B", "e1", "2099-U1-002"), ("2099-U1-002", "C", "e2", None))
def joined_answers(spark):
    """Questions with their answers by unit and number, then looked up by ids of which one is unknown."""
    rows = lookup.with_answers(_items(spark, {}, {}), _table(spark, "unit int, number int, answer string, explanation string", (1, 1, "B", "e1"), (1, 2, "C", "e2")))
    links = _table(spark, "of string, id string, pos int", ("2099-U1-001", "2099-U1-002", 1), ("2099-U1-002", "unknown", 2))
    found = bank.by_ids(links.select("id", "pos", "of"), rows.select("id", F.lit(True).alias("known")))
    return rows.join(found.select(F.col("of").alias("id"), F.when(F.col("known"), F.col("id")).alias("next")).alias("n"), "id").select("id", "answer", "explanation", "next")


@_gives("bank_no int, id string, extra string", (0, "2099-U1-001", None), (1, "2099-U1-001", "e"))
def united_banks(spark):
    one = _items(spark, {})
    return bank.union_banks(one.select("id"), one.select("id", F.lit("e").alias("extra"))).select("bank_no", "id", "extra")


@_gives("ord int, text_0 string, text_1 string, text_2 string", (1, "a", "x", None), (2, "b", None, "z"))
def aligned_readings(spark):
    read = lambda *rows: _table(spark, "ord int, text string", *rows)
    return lookup.zip_readings(read((1, "a"), (2, "b")), read((1, "x")), read((2, "z")))


_READ = "ord int, field string, text string"


def _readings(spark: SparkSession):
    layout = _table(spark, "ord int", (1,), (2,), (3,))
    a, b = _table(spark, _READ, (1, "stem", "甲乙丙丁"), (2, "stem", " ")), _table(spark, _READ, (1, "stem", "子丑寅卯"), (2, "stem", "补"), (9, "stem", "外"))
    return layout, validate.fuse_readings(layout, [a, b])


@_gives("ord int, text string, ratio double", (1, "甲乙丙丁", 0.0), (2, "补", None))
def fused_readings(spark):
    _, (fused, wrong) = _readings(spark)
    return fused.join(wrong.select("ord", "ratio"), "ord", "left").select("ord", "text", "ratio")


@_gives("ord int, reason string", (2, "answer"), (3, "field"))
def excluded_places(spark):
    layout, (fused, _) = _readings(spark)
    return validate.excluded(layout, fused, _table(spark, "ord int, answer string", (1, "A"), (2, "Z")), ["stem"])


@_gives("paper string, number int, pos int", ("p", 1, 1), ("p", 2, None), ("p", 3, 2), ("p", 4, 3), ("q", 1, 2), ("q", 2, 3), ("r", 1, None))
def number_alignment(spark):
    """Observed numbers (unknown, skipped, doubled, none at all) against the expected ones."""
    seen = _table(spark, "paper string, pos int, number int", ("p", 1, 1), ("p", 2, 3), ("p", 3, None), ("q", 1, 1), ("q", 2, 1), ("q", 3, 2))
    wanted = _table(spark, "paper string, ord int, number int", *(("p", n, n) for n in (1, 2, 3, 4)), ("q", 1, 1), ("q", 2, 2), ("r", 1, 1))
    return fusion.align_sequences(seen, wanted, ["paper"])


@_gives("id string, similar_to string, ratio double", ("n1", "o2", 0.9565), ("n3", "o1", 1.0))
def near_match_cases(spark):
    new = _table(spark, "id string, text string", ("n1", "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸子丑寅"), ("n2", "一二三四五六"), ("n3", "金木水火土金木水火土金木水"))
    old = _table(spark, "id string, text string", ("o1", "金木水火土金木水火土金木水"), ("o3", "金木水火土金木水火土金木水"), ("o2", "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸子丑卯"), ("o4", "一二三四五六"))
    return fusion.near_matches(new, old)


# ---- sessions


_SESSION = "session_id string, mode string, bank_version string, paper_format_version string, blueprint_version string, source string, subject_id string, subject_bank_version string, question_ids array<string>"


@_gives(
    "session_id string, reason string",
    ("ok", None), ("mode", "mode"), ("old", "version"), ("gone", "question"), ("subject", None), ("other", "subject"), ("late", "subject-version"), ("exam", None), ("exam-old", "version"),
)
def resumable_sessions(spark):
    one, two = "2099-U1-001", "2099-U1-002"
    rows = _table(
        spark, _SESSION, ("ok", "review", "v5", "1", None, None, None, None, [one, two]), ("mode", "other", "v5", "1", None, None, None, None, [one]), ("old", "review", "v4", "1", None, None, None, None, [one]),
        ("gone", "review", "v5", "1", None, None, None, None, [one, "x"]), ("subject", "review", "v5", "1", None, "subject", "x", "n0", [one]), ("other", "review", "v5", "1", None, "subject", "x", "n1", [one, two]),
        ("late", "review", "v5", "1", None, "subject", "x", "n9", [one]), ("exam", "exam", "v5", "1", "b1", None, None, None, [one, two]), ("exam-old", "exam", "v5", "1", "b0", None, None, None, [one]),
    )
    versions = {"review": {"bank_version": "v5", "paper_format_version": "1"}, "exam": {"bank_version": "v5", "blueprint_version": "b1", "paper_format_version": "1"}}
    return sessions.resumable(rows, _items(spark, {}, {"subject_id": "y"}), versions, ["n1", "n0"])


@_gives("version string, compatible boolean", ("n1", True), ("n0", True), ("m", False), (None, False))
def compatible_versions(spark):
    return _table(spark, "version string", ("n1",), ("n0",), ("m",), (None,)).select("version", sessions.compatible(F.col("version"), "n1", ["n0"]).alias("compatible"))


@_gives("session_id string, current_type string, locked string, submitted boolean", ("s", "B1", "A1/A2,A3", False), ("t", "A3", "A1/A2", False), ("u", "B1", "A1/A2,A3", True))
def type_cursors(spark):
    said = _table(spark, "session_id string, ts int, type string", ("s", 1, "A1/A2"), ("s", 2, "A1/A2"), ("s", 3, "A3"), ("t", 1, "B1"), ("t", 2, "A1/A2"), ("u", 3, "B1"), ("u", 2, "A3"), ("u", 1, "A1/A2"))
    return lookup.type_cursor(said, ["A1/A2", "A3", "B1"], ["ts"]).withColumn("locked", F.array_join("locked", ","))


@_gives("asked int, id string", (0, "a"), (1, "a"), (2, "b"), (99, "b"))
def clamped_pages(spark):
    pages = _table(spark, "id string, page_no int", ("a", 1), ("b", 2))
    out = [lookup.page_of(pages, n).select(F.lit(n).alias("asked"), "id") for n in (0, 1, 2, 99)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@_gives("removed string, next string", ("b", "c"), ("c", "b"), ("x", "c"))
def pages_after_removal(spark):
    order = _table(spark, "id string, pos int", ("a", 1), ("b", 2), ("c", 3))
    return _table(spark, "removed string, next string", *((x, lookup.next_after_removal(order, x)) for x in ("b", "c", "x")))


@_gives("local string, remote string, current string", ("a", "b", "b"), ("c", "b", "c"), ("a", "d", "a"), (None, "b", "b"), ("a", "x", "a"), (None, None, None))
def session_cursors(spark):
    """Which of a local and a remote session stays current: finished, older or unknown remote ones don't replace the local one."""
    rows = _table(spark, "key string, updated_at string, completed boolean", ("a", "2", False), ("b", "3", False), ("c", "4", False), ("d", "9", True))
    pairs = [("a", "b"), ("c", "b"), ("a", "d"), (None, "b"), ("a", "x"), (None, None)]
    return _table(spark, "local string, remote string, current string", *((x, y, merge.cursor(rows, x, y)) for x, y in pairs))


@_gives("queue string", ("a,b,c,d",))
def merged_queues(spark):
    return _table(spark, "queue string", (",".join(merge.merge_queues(["a", "b", "a"], ["c", "b", "d"])),))


@_gives("n int, wanted int, exact string, most string", (1, 5, "0,1", "0,1"), (2, 4, "0,2", "0,2"), (3, 1, None, ""), (4, 20, None, "0,1,2,3"), (5, 0, "", ""))
def chosen_blocks(spark):
    """Whole blocks of 3, 2, 1 and 3 items in this order for several totals; the first way to reach a total stays."""

    def run(wanted: int, at_most: bool, sizes=(3, 2, 1, 3)) -> str | None:
        sizes = (3, 2, 2, 3) if wanted == 1 else sizes
        try:
            return ",".join(map(str, paper.choose_blocks(list(sizes), wanted, at_most)))
        except ValueError:
            return None

    return _table(spark, "n int, wanted int, exact string, most string", *((n, w, run(w, False), run(w, True)) for n, w in enumerate((5, 4, 1, 20, 0), 1)))


_MOMENTS = [
    ("a", 1, "wrong", "review"), ("a", 2, "wrong", "exam"), ("b", 1, "wrong", "review"), ("b", 2, "mark", None), ("b", 3, "wrong", "review"), ("c", 1, "wrong", "review"), ("c", 2, "mark", None),
    ("c", 3, "remove", None), ("c", 4, "wrong", "exam"), ("d", 1, "mark", None), ("e", 1, "wrong", "review"), ("e", 2, "remove", None), ("f", 1, "mark", None), ("f", 2, "wrong", "exam"),
]
_BOOK = "question_id string, review boolean, exam boolean, wrong_count long, last_source string, correct boolean, created int, updated int"
_KEPT = (
    ("a", True, True, 2, "exam", False, 1, 2), ("b", True, False, 2, "review", True, 1, 3), ("c", False, True, 1, "exam", False, 4, 4), ("f", False, True, 1, "exam", False, 2, 2),
)


@_gives(_BOOK, *_KEPT)
def mistake_cycles(spark):
    """Entries of the mistake book: both sources, a mark that stays, a new cycle after a removal, marks without an entry."""
    rows = _table(spark, "question_id string, ts int, kind string, source string", *_MOMENTS).withColumns({"session_id": F.lit("s"), "seq": F.col("ts"), "unanswered": F.lit(False)})
    return events.mistake_fold(rows).select("question_id", "review", "exam", "wrong_count", "last_source", F.col("correct_in_book").alias("correct"), F.col("created_at").alias("created"), F.col("updated_at").alias("updated"))


@_gives(_BOOK, *_KEPT)
def mistake_steps(spark):
    """The same events through the step of the stream."""
    books: dict[str, tuple | None] = {}
    for q, ts, kind, source in _MOMENTS:
        books[q] = step(books.get(q), kind, source, False, ts)
    return _table(spark, _BOOK, *((q, e[0], e[1], e[2], e[3], e[5] is not None, e[6], e[7]) for q, e in books.items() if e))


# ---- rules that the tables never break


@_gives("subject_name string, n long", ("甲", 2))
def repeated_names(spark):
    return validate.duplicate_names(_table(spark, "subject_id string, subject_name string", ("a", "甲"), ("b", "甲"), ("c", "乙"), ("d", None), ("e", None)))


_G = {"group_id": "g", "group_start": 1, "group_end": 2, "prompt": "问"}
_SHARED = {k: "s" for k in LETTERS}


@_gives(
    "id string, severity string, kind string, field string",
    ("2018-U1-001", "error", "history-source-ocr", "stem"), ("2018-U1-001", "error", "ocr-symbol", "stem"), ("2018-U1-001", "error", "placeholder-explanation", "explanation"), ("2018-U1-001", "error", "history-source-ocr", "explanation"),
    ("2099-U1-002", "error", "missing-stem", "stem"), ("2099-U1-002", "error", "invalid-option-keys", "options"), ("2099-U1-002", "error", "missing-option", "option-E"), ("2099-U1-002", "error", "invalid-answer", "answer"),
    ("2099-U1-002", "error", "empty-explanation", "explanation"), ("2099-U1-003", "error", "invalid-type", "type"), ("2099-U1-003", "error", "unexpected-group-id", "group_id"), ("2099-U1-003", "error", "embedded-answer-marker", "stem"),
    ("2099-U1-003", "error", "embedded-answer-marker", "option-A"), ("2099-U1-004", "warning", "unusable-explanation", "explanation"), ("2099-U1-004", "warning", "ocr-symbol", "explanation"), ("2099-U1-004", "error", "missing-group-id", "group_id"), ("2099-U1-004", "error", "missing-group-prompt", "prompt"),
    ("2099-U1-004", "error", "missing-shared-stem", "shared_stem"), ("2099-U1-005", "warning", "watermark", "explanation"), ("2099-U1-005", "warning", "replacement-character", "stem"), ("2099-U1-005", "warning", "unit-footer", "option-A"), ("2099-U1-005", "warning", "ocr-symbol", "option-A"),
    ("2099-U1-005", "warning", "source-placeholder", "option-B"), ("2099-U1-005", "error", "invalid-shared-options", "shared_options"), ("2099-U1-006", "warning", "merged-question-anchor", "stem"),
    ("2099-U1-006", "warning", "trailing-next-question-anchor", "explanation"), ("2099-U1-007", "error", "duplicate-question-content", None), ("2099-U1-007", "error", "duplicate-id", "id"),
    ("g", "error", "group-type-conflict", "group_id"), ("g", "error", "group-scope-conflict", "group_id"), ("g", "error", "incomplete-group-members", "group_start/group_end"), ("h", "error", "group-range-conflict", "group_start/group_end"),
    ("h", "error", "shared-options-conflict", "shared_options"), ("k", "error", "shared-stem-conflict", "shared_stem"),
)
def audit_cases(spark):
    """One bank in which every structural rule is broken; the label in the last row's explanation is excepted."""
    rows = _items(
        spark, {"id": "2018-U1-001", "stem": "甲@乙●", "explanation": "原文件未提供解析。"}, {"stem": "　", "options": {k: "x" for k in "ABCD"}, "answer": "E", "explanation": " "},
        {"type": "X", "stem": "题 答案：A", "options": _SHARED | {"A": "解析：x"}} | _G, {"type": "A3", "explanation": "D略。【某某】"},
        {"type": "B1", "stem": "□字", "options": _SHARED | {"A": "甲【第一单元", "B": "待补充"}, "explanation": "见www.x", "shared_options": _SHARED | {"C": " "}} | _G | {"group_id": "h"},
        {"stem": "甲。6.患者", "explanation": "乙。7."}, {"stem": "同题", "explanation": "正"}, {"id": "2099-U1-007", "number": 7, "stem": "同题 ", "options": {k: f"{k}项6" for k in LETTERS}, "explanation": "【主治】正"},
        {"unit": 2, "type": "B1", "shared_options": _SHARED, "options": _SHARED} | _G, {"type": "B1", "shared_options": _SHARED | {"A": "t"}, "options": _SHARED} | _G | {"group_id": "h", "group_start": 5},
        {"type": "A3", "shared_stem": "甲"} | _G | {"group_id": "k", "group_start": 11, "group_end": 12}, {"type": "A3", "shared_stem": "乙"} | _G | {"group_id": "k", "group_start": 11, "group_end": 12},
    )
    labels = _table(spark, "id string, field string, label string", ("2099-U1-007", "explanation", "【主治】"))
    return quality.structural_issues(rows, exceptions=labels).select("id", "severity", "kind", "field")


@_gives(
    "id string, field string, issue_type string, confidence string",
    ("2099-U1-001", "stem", "internal-cjk-whitespace", "medium"), ("2099-U1-001", "explanation", "watermark-or-source-noise", "high"), ("2099-U1-001", "explanation", "possible-next-question-number", "high"),
    ("2099-U1-002", "stem", "suspicious-ocr-symbol", "medium"), ("2099-U1-004", "stem", "header-footer-or-ocr-tool-noise", "high"), ("2099-U1-004", "option-A", "replacement-or-mojibake-character", "high"),
    ("2099-U1-004", "explanation", "embedded-question-type-label", "medium"), ("2099-U1-004", "explanation", "internal-cjk-whitespace", "medium"), ("2099-U1-005", "stem", "trailing-ocr-garbage", "medium"), ("2099-U1-005", "option-A", "possible-bian-character-confusion", "medium"),
    ("2099-U1-005", "option-B", "possible-feiwei-character-confusion", "medium"), ("2099-U1-005", "explanation", "unbalanced-brackets", "medium"), ("2099-U1-006", "stem", "repeated-whitespace", "medium"),
    ("2099-U1-006", "explanation", "embedded-latin-letter-confusion", "high"),
)
def scan_cases(spark):
    """One bank in which every rule of the scan hits, and texts that only look like it."""
    rows = _items(
        spark, {"stem": "医 学测试题", "explanation": "正常。2. 【一点笔记】"}, {"stem": "异常 O 字符"}, {"stem": "霍乱O139血清型"}, {"stem": "正文第 12 页", "options": {"A": "甲□"}, "explanation": "见 AI型题 甲"},
        {"stem": "正文。d", "options": {"A": "辩证", "B": "肺瘘"}, "explanation": "甲）乙（"}, {"stem": "a  b", "explanation": "甲o乙"},
    )
    return quality.scan_candidates(rows).select("id", "field", "issue_type", "confidence")


@_gives("first_id string, members long, answers long", ("2099-U1-001", 2, 2))
def conflict_cases(spark):
    """Equal stem and option set, other answer texts; the third item's answer text is the same under another letter."""
    o = {"A": "甲", "B": "乙", "C": "丙", "D": "丁", "E": "戊"}
    rows = _items(spark, {"stem": "Ａ题，", "options": o}, {"stem": "a 题", "options": o, "answer": "B"}, {"stem": "乙题", "options": o}, {"stem": "乙题", "options": o | {"A": "乙", "B": "甲"}, "answer": "B"})
    return quality.answer_conflicts(rows)


@_gives("first_id string, members long, answers long", ("2099-U1-001", 2, 2))
def ordered_conflict_cases(spark):
    """The same with options in letter order: other letters make another item."""
    o = {"A": "甲", "B": "乙", "C": "丙", "D": "丁", "E": "戊"}
    rows = _items(spark, {"stem": "Ａ题？", "options": o}, {"stem": "A 题", "options": o, "answer": "B"}, {"stem": "乙题", "options": o}, {"stem": "乙题", "options": o | {"A": "乙", "B": "甲"}})
    return quality.duplicate_answer_conflicts(rows)


@_gives("first_id string, members long, groups long", ("2099-U1-001", 2, 2))
def repeated_explanation_cases(spark):
    return quality.repeated_explanations(_items(spark, {"explanation": "ＡＢＣ（甲）"}, {"explanation": "ABC甲 "}, {"explanation": "乙", "group_id": "g"}, {"explanation": "乙。", "group_id": "g"}))


@_gives("id string", ("2099-U1-001",), ("2099-U1-003",))
def placeholder_cases(spark):
    return quality.placeholder_stems(_items(spark, {"stem": "【配伍题】（）"}, {"stem": "配伍题一道"}, {"stem": " A3 / A4型题"}))


@_gives("group_id string, kind string", ("a", "single"), ("b", "blank-prompt"), ("c", "options"), ("d", "child-numbers"), ("e", "blank-prompt"))
def group_cases(spark):
    g = lambda x, **more: {"group_id": x, "type": "B1", "prompt": "问", "options": _SHARED, "shared_options": _SHARED} | more
    rows = [
        g("a"), g("b", prompt="B1型题"), g("b"), g("c", options=_SHARED | {"A": "t"}), g("c"), g("d", source_sub_question_number=2), g("d", source_sub_question_number=1),
        g("e", type="A3", prompt=" "), g("e", type="A3"), g("f", options=_SHARED | {"A": " ｓ？"}, source_sub_question_number=1), g("f", source_sub_question_number=2), g("h", type="A3", prompt="B1型题"), g("h", type="A3"),
    ]
    return quality.group_member_issues(_items(spark, *rows))


@_gives("id string, missing string", ("2099-U1-002", "BE"),)
def missing_option_cases(spark):
    letters = F.array(*(F.lit(k) for k in LETTERS))
    rows = _items(spark, {}, {"options": {"A": "x", "B": " ", "C": "x", "D": "x"}})
    return rows.select("id", F.array_join(F.filter(letters, lambda k: X.trimmed(F.try_element_at("options", k)) == ""), "").alias("missing")).filter("missing <> ''")


@_gives("group_id string, contiguous boolean", ("a", True), ("b", False), ("c", True))
def contiguity_cases(spark):
    """Places in the bank decide, not numbers: b's members are apart although its numbers are 1, 1 and 3."""
    rows = [("a", 7), ("a", 9), ("b", 1), ("b", 1), ("c", 5), ("b", 3)]
    return sequence.group_contiguity(_items(spark, *({"group_id": g, "number": n} for g, n in rows)), "bank_ord")


@_gives("id string, own double, neighbours double, suspect boolean", ("2099-U1-002", 0.0, 0.5, True), ("2099-U1-003", 1.0, 0.0, False))
def neighbour_cases(spark):
    """The second explanation belongs to the first item; groups, the first and the last row aren't judged; another subject's neighbour scores 0."""
    rows = [("甲乙丙", "甲乙丙"), ("丁戊己", "甲，乙丙。"), ("庚辛壬", "庚辛壬"), ("子丑寅", "庚辛壬"), ("卯辰巳", "子丑寅"), ("午未申", "子丑寅")]
    more = [{}, {}, {}, {"subject_id": "y", "group_id": "g"}, {"subject_id": "y", "group_id": "g"}, {"subject_id": "y"}]
    out = sequence.neighbour_overlap(_items(spark, *({"stem": s, "explanation": e} | m for (s, e), m in zip(rows, more))), ["number", "id"], "stem", "explanation", "subject_id")
    return out.select("id", F.round("own", 6).alias("own"), F.round("neighbours", 6).alias("neighbours"), "suspect")


@_gives("session_id string, total long, wrong long, wrong_ids string", ("s", 3, 2, "b,a"))
def wrong_ids(spark):
    rows = _table(spark, "session_id string, pos int, question_id string, right boolean, unanswered boolean", ("s", 1, "b", False, True), ("s", 2, "c", True, False), ("s", 3, "a", False, False))
    return events.grade_totals(rows).select("session_id", "total", "wrong", F.array_join("wrong_ids", ",").alias("wrong_ids"))


@_gives("id string, known boolean", ("a", True), ("b", False))
def unknown_patches(spark):
    """Ids of patches that the bank lacks."""
    status = patches.patch_status(_items(spark, {"id": "a"}), _table(spark, "patch_id long, id string, field string, before string, after string", (1, "a", "stem", "题干0", "x"), (2, "b", "stem", "y", "z")))
    return written(status.select("id", (F.col("status") != "unknown-id").alias("known")), "literal")
