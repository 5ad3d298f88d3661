import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from itemweave.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_trimmed_drops_wide_spaces_and_marks(spark):
    assert one(spark, "﻿　 甲 乙 \n", X.trimmed) == "甲 乙"
    assert one(spark, None, X.trimmed) == ""


def test_content_key_folds_width_and_case(spark):
    assert one(spark, "Ａb①㎜，甲 乙！", X.content_key) == "ab1mm甲乙"
    assert one(spark, None, X.content_key) == ""


def test_excerpt(spark):
    assert one(spark, "a  b\n c", X.excerpt) == "a b c"
    long = one(spark, "字" * 300, X.excerpt)
    assert len(long) == 240 and long.endswith("字...")


def test_unbalanced_brackets_against_a_fold(spark):
    def brute(t):
        for a, b in X.BRACKETS:
            d = 0
            for c in t:
                d += (c == a) - (c == b)
                if d < 0:
                    return True
            if d:
                return True
        return False

    rng = random.Random(3)
    texts = ["", "甲", *("".join(rng.choice("（）()【】甲[]") for _ in range(rng.randint(1, 8))) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert {r.x: r.y for r in df.select("x", X.unbalanced(F.col("x")).alias("y")).collect()} == {t: brute(t) for t in texts}


def test_numbers(spark):
    assert [one(spark, t, X.chinese_number) for t in ("三", "十", "十二", "二十", "九十九", "百", "甲", "")] == [3, 10, 12, 20, 99, 100, None, None]
    assert [one(spark, t, X.scanned_number) for t in ("12. 患者", "I2、", "&3.", "IL", "601.", "甲1", "（7）")] == [12, 12, 83, None, None, None, 7]
    assert one(spark, "Ｂ", X.answer_letter) == "B"


def test_answers_of_line(spark):
    assert one(spark, "(2)A （3）Ｂ 4.c", X.answers_of_line) == {2: "A", 3: "B", 4: "C"}
    assert one(spark, "(2)A (2)B", X.answers_of_line) == {2: "B"}
    assert one(spark, "为 d", X.answers_of_line) == {0: "D"}
    assert one(spark, "无", X.answers_of_line) is None


def test_bigrams_and_containment(spark):
    assert one(spark, "甲乙甲乙", X.bigrams) == ["甲乙", "乙甲"]
    assert one(spark, "甲", X.bigrams) == []
    row = spark.sql("select array('a','b','c') e, array('b','x') a, cast(array() as array<string>) z")
    assert row.select(X.containment(F.col("e"), F.col("a"))).first()[0] == 1 / 3
    assert row.select(X.containment(F.col("z"), F.col("a"))).first()[0] == 0


def test_ids_and_ratio(spark):
    assert one(spark, "中医儿科学题", X.subject_id) == "subject-886e0290c4c6"
    assert one(spark, "2021-U3-046", X.year_of) == 2021 and one(spark, "20211", X.year_of) is None
    df = spark.createDataFrame([("霍乱弧菌", "霍乱病菌"), (None, "a")], "a string, b string")
    rows = [r.r for r in df.select(X.match_ratio("a", "b").alias("r")).collect()]
    assert rows == [SequenceMatcher(None, "霍乱弧菌", "霍乱病菌").ratio(), None]
