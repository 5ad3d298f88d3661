"""Template residue and error-page text: a linear classifier on hashed n-grams, trained from weak labels.

Explanations are cut into clauses. A clause is weakly positive if a phrase or response-status pattern of PATTERNS matches it.
The model sees n-grams, length, where the clause stands (alone, first, last) and, as title features, what it has in common with
the item's stem, never the patterns themselves, so it also finds residue that no pattern names, and drops patterns' chance hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.llm import kernel as K
from itemweave.llm import linear
from itemweave.operators.sequence import numbered
from itemweave.session import written

#: Rows of each weak label that the model is fitted on; they are the first in the order of a hash of id.
TRAIN_ROWS = 5000
SLICE = 64  # rows that are labelled at first for each one that is wanted
PENALTY, ROUNDS, THRESHOLD = 2e-7, 150, 0.0
HELD_OUT_OF = 4  # one in so many sources of each script is held out for validation
COUNTS = ("clauses", "weak", "agreed", "missed", "extra")

# Phrases and response statuses, in the regular-expression dialect that Python and Java share.
PATTERNS = (
    r"\{\{[^{}]*\}\}", r"\$\{[^{}]*\}", r"<%[^%]*%>", r"%\(\w+\)s", r"%[sd](?![a-z])", r"\{(?:\d|[a-z_]{3,})\}", r"\[\[[^\[\]]+\]\]", r"@@[^@]+@@", r"__[A-Z_]+__", r"_{4,}",
    r"\[(?:TBD|TODO|INSERT[^\]]*|PLACEHOLDER|[一-鿿]{1,4}名称)\]", r"<[一-鿿]{2,14}>", r"\bTODO\b", r"\bTBD\b", r"X{5,}", r"x{3,}", r"…{4,}",
    r"占位|待补|待填写?|此处(?:填写|插入|输入)|请(?:在此|替换)|示例文字|测试测试|解析正文|(?i:lorem ipsum|placeholder|coming soon)",
    r"^(?:undefined|null|NULL|None|nil|NaN|N/A|#N/A|#REF!|#VALUE!|#DIV/0!|#NAME\?|\[object Object\])$",
    r"\w+Exception\b|Traceback|SQLSTATE|KeyError|TypeError|Undefined (?:array key|index|variable)|Segmentation fault",
    r"\b[45]\d\d (?:Not Found|Forbidden|Unauthorized|Bad Gateway|Bad Request|Internal Server Error|Service Unavailable|Gateway Time-?out)|HTTP Status \d+|错误码",
    r"页面(?:不存在|走丢|已被删除)|服务器(?:开小差|错误|繁忙)|系统繁忙|加载(?:中|失败)|正在验证|访问环境|请稍候|请稍后再试|返回首页|请求的资源|请求编号|Request id",
    r"暂无(?:解析|答案解析)|解析更新中|敬请期待|暂未收录|(?i:no explanation (?:is )?available)",
    r"启用 ?JavaScript|不支持脚本|运行脚本|登录(?:已过期|后查看)|请(?:先)?登录|无权查看|(?i:(?:enable|requires?) javascript|please (?:log|sign) ?in|access denied|verify you are human)",
    r"(?i:checking your browser|just a moment|please wait|redirecting|page (?:was )?not found|try again later|session (?:has )?expired|must be logged in|subscribe to (?:view|read))",
    r"请刷新|跳转|验证码|访问(?:过于)?频繁|权限不足|网络异常|请求超时|解析(?:失败|待更新)|(?:尚未|没有)(?:提供|收录)?解析|稍后补充|内容(?:不存在|已删除)",
)
_WEAK = re.compile("|".join(PATTERNS))
#: Every match of a pattern holds one of these (letter case ignored); only texts that hold one are tried with the patterns.
TRIGGERS = (
    "{ } <% %( %s %d [[ @@ __ [tbd [todo [insert [placeholder 名称] todo tbd xxx …………  占位 待补 待填 此处 请在此 请替换 示例文字 测试测试 解析正文 lorem placeholder "
    "undefined null none nil nan n/a #ref #value #div #name [object exception traceback sqlstate keyerror typeerror segmentation found forbidden unauthorized gateway "
    "request error unavailable http 错误码 页面 服务器 系统繁忙 加载 验证 环境 请稍 返回 资源 编号 暂无 更新中 敬请 暂未 explanation javascript 脚本 登录 无权 denied human "
    "please soon browser moment redirect again expired logged subscribe 刷新 跳转 验证 频繁 权限 网络 超时 失败 待更新 尚未 没有 补充 内容"
).split() + ["<" + c for c in "请此在填写输入"]
_ANGLE = re.compile(r"<[一-鿿]{2,14}>")


def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for t in TRIGGERS:
        automaton.add_word(t, t)
    automaton.make_automaton()
    return automaton


def weak(text: str, automaton) -> bool:
    """Whether a clause of the text is weakly positive."""
    if next(automaton.iter(text.lower()), None) is None and not ("<" in text and _ANGLE.search(text)):
        return False
    return any(_WEAK.search(c) for c in clauses(text))


_CUT = re.compile(r"(?<=[。；！？!?;\n）】])|(?<=\. )|(?<=，)(?![a-z])")
_WORD = re.compile(r"[A-Za-z.!,)]+")  # one Latin word: in running text a broken word can look like a value, so the value has to be exact
_HIDDEN = re.compile("[­​-‏⁠﻿︀-️]")


def clauses(text: str) -> list[str]:
    """The clauses of a text without marks at their ends that only close them; invisible characters are dropped."""
    out = (x.strip().rstrip("。，；.,; ") or x.strip() for x in _CUT.split(_HIDDEN.sub("", text)))
    return [x for x in out if x]


_SHARES = np.array([0.0, 0.05, 0.15, 0.3, 0.5])


def _common(texts: list[str], text_no: np.ndarray, titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(share of a clause's pairs of letters that its title holds, share of the title's that the clause holds), as steps of _SHARES."""

    def pairs(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, no = K.letters(of)
        inside = no[:-1] == no[1:] if len(flat) else np.zeros(0, bool)
        return (flat[:-1].astype(np.uint64) << np.uint64(21) | flat[1:])[inside] if len(flat) else np.zeros(0, np.uint64), no[:-1][inside] if len(flat) else np.zeros(0, np.int64)

    (a, owner), (b, of) = pairs(texts), pairs(titles)
    key = lambda gram, no: K.mix64(gram) ^ K.mix64(no.astype(np.uint64) + np.uint64(1))
    hit = np.isin(key(a, text_no[owner] if len(owner) else owner), key(b, of))
    n, m = np.bincount(owner, minlength=len(texts)), np.bincount(of, minlength=len(titles))
    shared = np.bincount(owner, weights=hit, minlength=len(texts))
    step = lambda x: np.searchsorted(_SHARES, x, side="left")
    return step(shared / np.maximum(n, 1)), step(shared / np.maximum(m[text_no], 1))


def _features(parts: list[list[str]], titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, clause number, text number of each clause)."""
    texts = [c for p in parts for c in p]
    count = np.array([len(p) for p in parts], np.int64)
    text_no = np.repeat(np.arange(len(parts)), count)
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), text_no
    slot, owner = linear.ngrams(texts)
    length = np.minimum(np.array([len(c) for c in texts]) // 4, 8)
    starts = np.cumsum(count) - count
    place = np.zeros(len(texts), np.int64)
    place[starts[count > 0]] += 1
    place[(starts + count - 1)[count > 0]] += 2  # 3: the only clause
    every = np.arange(len(texts))
    of_clause, of_title = _common(texts, text_no, titles)
    named = [linear.named(x, k) for k, x in enumerate((length, place, of_clause, of_title), 1)]
    return np.concatenate([slot, *named]), np.concatenate([owner, *[every] * len(named)]), text_no


def _key() -> Column:
    return F.xxhash64(F.lit(17), "id")


def training_rows(questions: DataFrame) -> list:
    """At most TRAIN_ROWS explanations with and TRAIN_ROWS without a weak label: (explanation, stem, k, weak).

    They are the first of each label in the order of k, a hash of id. Only rows below a bound of k are labelled: SLICE times
    TRAIN_ROWS of them are expected, and more are taken until both labels are full or no row is left. So what is labelled
    and written doesn't grow with the table.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, kept = _automaton(), {True: [], False: []}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k", "explanation", "stem"))):
                kept[weak(row[1], automaton)].append(row)
            for label, rows in kept.items():
                if len(rows) > TRAIN_ROWS:
                    kept[label] = sorted(rows, key=lambda r: (r[0], r[1], r[2]))[:TRAIN_ROWS]
        for label, rows in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([label] * len(rows), pa.bool_())],
                ["k", "explanation", "stem", "weak"],
            )

    rows = questions.filter("explanation is not null").select(_key().alias("k"), "explanation", F.coalesce("stem", F.lit("")).alias("stem"))
    part = min(1.0, SLICE * TRAIN_ROWS / max(questions.count(), 1))
    while True:
        below = rows if part >= 1 else rows.filter(F.col("k") < int((part * 2 - 1) * 2**63))
        labelled = written(below.mapInArrow(pick, "k long, explanation string, stem string, weak boolean"), "p2-train")
        n = {r.weak: r.n for r in labelled.groupBy("weak").agg(F.count("*").alias("n")).collect()}
        if part >= 1 or min(n.get(True, 0), n.get(False, 0)) >= TRAIN_ROWS:
            break
        part = min(1.0, part * SLICE)
    order = ["k", "explanation", "stem"]
    some = labelled.filter("weak").orderBy(*order).limit(TRAIN_ROWS).unionByName(labelled.filter("not weak").orderBy(*order).limit(TRAIN_ROWS))
    return sorted(some.collect(), key=lambda r: (r.k, r.explanation, r.stem))


def fit(rows: list) -> np.ndarray:
    """Weights fitted on the distinct clauses of the rows; the negative label has five times the total weight."""
    parts = [clauses(r.explanation) for r in rows]
    slot, owner, _ = _features(parts, [r.stem for r in rows])
    texts = [c for p in parts for c in p]
    label = np.array([bool(_WEAK.search(c)) for c in texts], float)
    if not len(label) or not label.any():
        w = np.zeros(linear._SIZE + 1)
        w[-1] = -1.0
        return w
    weight = np.where(label > 0, 1 / label.sum(), 5 / max((1 - label).sum(), 1))
    return linear.fit(slot, owner, label, weight, PENALTY, ROUNDS)


def _apply(weights: np.ndarray, texts: list[str], titles: list[str]) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
    """(which clauses are residue, clauses of the texts, text number of each clause)."""
    parts = [clauses(t) if t else [] for t in texts]
    slot, owner, text_no = _features(parts, titles)
    n = len(text_no)
    if not n:
        return np.zeros(0, bool), parts, text_no
    bad = linear.scores(weights, slot, owner, n) > THRESHOLD
    flat = [c for p in parts for c in p]
    for i in np.flatnonzero(bad):
        if _WORD.fullmatch(flat[i]) and not _WEAK.search(flat[i]):
            bad[i] = False
    return bad, parts, text_no


def records_with_weights(questions: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, residue): the questions whose explanation holds residue, with the clauses found."""
    packed = weights.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = packed.astype(np.float64)
        for part in K.bounded(batches, "explanation"):
            bad, parts, text_no = _apply(w, part.column("explanation").to_pylist(), part.column("stem").to_pylist())
            flat = [c for p in parts for c in p]
            found: dict[int, list[str]] = {}
            for i in np.flatnonzero(bad):
                found.setdefault(int(text_no[i]), []).append(flat[i])
            ids = part.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in found], pa.string()), pa.array(list(found.values()), pa.list_(pa.string()))], ["id", "residue"]
            )

    rows = questions.filter("explanation is not null and explanation <> ''").select("id", "explanation", F.coalesce("stem", F.lit("")).alias("stem"))
    return rows.mapInArrow(score, "id string, residue array<string>")


def records(questions: DataFrame) -> DataFrame:
    """(id, residue) of every question whose explanation is or contains residue.

    Null and empty explanations are no cases; long texts are read whole; an empty table gives no rows.
    """
    return records_with_weights(questions, fit(training_rows(questions)))


def found(questions: DataFrame) -> DataFrame:
    return records(questions).select("id").distinct()


def without_residue(questions: DataFrame) -> DataFrame:
    """The bank without those records."""
    return questions.join(found(questions), "id", "left_anti")


def _counts(weights: np.ndarray, rows: DataFrame) -> DataFrame:
    """(source, clauses, weak, agreed, missed, extra) of rows (source, explanation, stem), one row for each source of a part of a batch."""
    packed = weights.astype(np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, automaton = packed.astype(np.float64), _automaton()
        for part in K.bounded(batches, "explanation"):
            texts = part.column("explanation").to_pylist()
            bad, parts, text_no = _apply(w, texts, part.column("stem").to_pylist())
            label = np.array([m and bool(_WEAK.search(c)) for m, p in zip((weak(t, automaton) for t in texts), parts) for c in p], bool)
            names, of = np.unique(np.array(part.column("source").to_pylist(), object), return_inverse=True)
            each = [np.bincount(of[text_no], weights=x, minlength=len(names)).astype(np.int64) for x in (np.ones(len(label)), label, label & bad, label & ~bad, bad & ~label)]
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), *map(pa.array, each)], ["source", *COUNTS])

    return rows.mapInArrow(count, f"source string, {', '.join(f'{c} long' for c in COUNTS)}")


def held_out(rows: DataFrame) -> DataFrame:
    """(source) of every HELD_OUT_OF-th source of each script, by name, the first included.

    A source's script is Han if its explanations hold at least as many ideographs as Latin letters. Of a script with one source
    none is held out: without it nothing of that script would be left to learn from.
    """
    count = lambda p: F.sum(F.length(F.regexp_replace(F.coalesce("explanation", F.lit("")), f"[^{p}]", "")))
    scripts = rows.groupBy("source").agg((count("\\p{IsHan}") >= count("A-Za-z")).alias("han"))
    places = written(numbered(scripts, "han", "source"), "p2-sources")
    first = places.groupBy("han").agg(F.min("pos").alias("low"), F.count("*").alias("n"))
    return places.join(F.broadcast(first), "han").filter((F.col("n") > 1) & ((F.col("pos") - F.col("low")) % HELD_OUT_OF == 0)).select("source")


def validation(questions: DataFrame) -> DataFrame:
    """(source, clauses, weak, agreed, missed, extra) on sources that the model never saw (held_out), against the weak labels.

    Sources come from the whole table, and every explanation of a held-out source is counted; a source without any has
    zeros. Questions without a source are those of the source ''. Only the sample that the model is fitted on is bounded.
    """
    rows = questions.select("id", F.coalesce("source", F.lit("")).alias("source"), "explanation", F.coalesce("stem", F.lit("")).alias("stem"))
    held = written(held_out(rows), "p2-held")
    weights = fit(training_rows(rows.join(held, "source", "left_anti")))
    texts = rows.filter("explanation is not null").join(held, "source", "left_semi").select("source", "explanation", "stem")
    counts = _counts(weights, texts).groupBy("source").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return held.join(counts, "source", "left").select("source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS))
