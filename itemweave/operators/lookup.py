"""Mandatory joins, evidence, corrections by source number, and views of a session's result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.schema import GROUPED_TYPES, LETTERS


class MissingKeys(KeyError):
    """Rows of a mandatory lookup have no partner."""


def mandatory(rows: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which every row must find a partner; checked before anything is returned."""
    missing = rows.join(dimension.select(*on).distinct(), on, "left_anti")
    found = missing.select(*on).distinct().limit(5).collect()
    if found:
        raise MissingKeys(f"no partner for {[tuple(r) for r in found]}")
    return rows.join(dimension, on)


def with_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with answer and explanation by (unit, number); each must have one."""
    return mandatory(questions.drop("answer", "explanation"), answers.select("unit", "number", "answer", "explanation"), ["unit", "number"])


def corrected_options(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """(correction_id, status) of corrections (correction_id, subject_id, source_question_number, letter, before, after, expected_ids).

    'ok' if the items with that subject and number are exactly the expected ones in order and all hold `before` in options, and in
    shared options where they have them; else 'other-items' or 'changed'.
    """
    rows = corrections.join(items.select("id", "subject_id", "source_question_number", "number", "options", "shared_options"), ["subject_id", "source_question_number"], "left")
    fits = (F.try_element_at("options", "letter").eqNullSafe(F.col("before"))) & (
        F.col("shared_options").isNull() | F.try_element_at("shared_options", "letter").eqNullSafe(F.col("before"))
    )
    found = rows.groupBy("correction_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("number", "id")))), lambda x: x["id"]).alias("ids"),
        F.first("expected_ids").alias("expected"), F.min(fits).alias("fits"),
    )
    status = F.when(~F.col("ids").eqNullSafe(F.col("expected")), "other-items").when(F.col("fits"), "ok").otherwise("changed")
    return found.select("correction_id", status.alias("status"))


class CorrectionConflict(ValueError):
    """A verified correction no longer fits; the message names the corrections."""


def corrected(items: DataFrame, corrections: DataFrame, strict: bool = True) -> DataFrame:
    """The items with all fitting corrections applied to options, and to shared options where an item has them.

    Strict: any correction whose items or texts have changed raises CorrectionConflict before anything is returned. Without
    it such corrections are left out. Of several corrections of one letter the one with the largest correction_id counts.
    """
    status = corrected_options(items, corrections)
    if strict:
        wrong = status.filter("status <> 'ok'").orderBy("correction_id").limit(5).collect()
        if wrong:
            raise CorrectionConflict(", ".join(f"{r.correction_id}: {r.status}" for r in wrong))
    good = corrections.join(status.filter("status = 'ok'").select("correction_id"), "correction_id")
    by = ["subject_id", "source_question_number"]
    new = good.groupBy(*by, "letter").agg(F.max_by("after", "correction_id").alias("after")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("letter", "after"))).alias("fix_"))
    put = lambda c: F.transform_values(c, lambda k, v: F.coalesce(F.try_element_at("fix_", k), v))
    rows = items.join(new, by, "left")
    return rows.withColumns({c: F.when(F.col("fix_").isNull(), F.col(c)).otherwise(put(c)) for c in ("options", "shared_options")}).select(*items.columns)


def evidence(backfills: DataFrame, assignments: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, source_ids, organizations, corroborated): the sources of each backfill in their order; every link must resolve.

    assignments: (id, source_ids); sources: (source_id, organization). Corroborated means two organisations or more.
    """
    rows = mandatory(backfills.select("id"), assignments, ["id"])
    links = rows.select("id", F.posexplode("source_ids").alias("pos", "source_id"))
    full = mandatory(links, sources.select("source_id", "organization"), ["source_id"])
    return full.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_id"))), lambda x: x["source_id"]).alias("source_ids"),
        F.count_distinct("organization").alias("organizations"), (F.count_distinct("organization") >= 2).alias("corroborated"),
    )


def undisputed(backfills: DataFrame, disputes: DataFrame) -> DataFrame:
    """The backfills without those of disputed items."""
    return backfills.join(disputes.select("id").distinct(), "id", "left_anti")


def settled(backfills: DataFrame, disputes: DataFrame, number: int) -> DataFrame:
    """The backfills, if there are exactly `number` disputed items and none of them is backfilled; else ValueError."""
    ids = disputes.select("id").distinct()
    found, both = ids.count(), backfills.join(ids, "id", "left_semi").count()
    if found != number or both:
        raise ValueError(f"{found} disputes instead of {number}, {both} of them backfilled")
    return backfills


def zip_readings(*readings: DataFrame, on: str = "ord") -> DataFrame:
    """Readings of one layout side by side by ordinal: text_0, text_1, ...; a reading that lacks an ordinal is null there."""
    out = None
    for n, r in enumerate(readings):
        side = r.select(on, F.col("text").alias(f"text_{n}"))
        out = side if out is None else out.join(side, on, "full")
    return out


def explained(items: DataFrame, placeholder: str) -> DataFrame:
    """The items with an explanation that is neither blank nor the placeholder."""
    e = F.trim(F.coalesce("explanation", F.lit("")))
    return items.filter((e != "") & (e != placeholder))


def pruned_ids(session: DataFrame, book: DataFrame, bank: DataFrame) -> DataFrame:
    """The rows (id, pos) of a session whose question is still in the mistake book and in the bank."""
    return session.join(book.select(F.col("question_id").alias("id")), "id", "left_semi").join(bank.select("id"), "id", "left_semi")


def result_groups(graded: DataFrame, bank: DataFrame) -> DataFrame:
    """(session_id, block, first_wrong, wrong_ids): the blocks of an exam with wrong members, each once, with its wrong members in order.

    graded: (session_id, pos, question_id, right). Items outside A3 and B1 groups stand alone.
    """
    rows = graded.filter(~F.col("right")).join(bank.select(F.col("id").alias("question_id"), "type", "group_id"), "question_id")
    grouped = F.col("type").isin(*GROUPED_TYPES) & (F.coalesce("group_id", F.lit("")) != "")
    rows = rows.withColumn("block", F.when(grouped, F.col("group_id")).otherwise(F.col("question_id")))
    return rows.groupBy("session_id", "block").agg(
        F.min("pos").alias("first_wrong"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "question_id"))), lambda x: x["question_id"]).alias("wrong_ids")
    )


def page_of(pages: DataFrame, page: int) -> DataFrame:
    """The rows (with page_no) of a page; numbers outside 1..n are clamped."""
    last = pages.agg(F.max("page_no")).first()[0] or 1
    return pages.filter(F.col("page_no") == max(1, min(int(last), int(page or 1))))


def next_after_removal(order: DataFrame, removed: str) -> str | None:
    """The id (of id, pos) after the removed one, else the last that remains."""
    at = order.filter(F.col("id") == removed).select("pos").first()
    rest = order.filter(F.col("id") != removed)
    if at is not None:
        after = rest.filter(F.col("pos") > at.pos).agg(F.min_by("id", "pos")).first()[0]
        if after is not None:
            return after
    return rest.agg(F.max_by("id", "pos")).first()[0]


def type_cursor(confirmations: DataFrame, types: list[str], order: list[str]) -> DataFrame:
    """(session_id, current_type, locked, submitted): where the cursor of each session stands after its confirmations in order.

    confirmations: (session_id, type, *order). A confirmation counts if its type is the current one; it locks that type and
    moves on. Confirmations of other types are late or repeated and do nothing. The last type's one submits, and nothing
    counts after it. A session's confirmations are few, so they are folded as one array.
    """
    names = F.array(*(F.lit(t) for t in types))
    said = confirmations.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*order, "type"))).alias("said"))
    step = lambda n, x: F.when((n < len(types)) & x["type"].eqNullSafe(F.try_element_at(names, n + 1)), n + 1).otherwise(n)
    done = said.select("session_id", F.aggregate("said", F.lit(0), step).alias("n"))
    at = F.least(F.col("n"), F.lit(len(types) - 1))
    return done.select("session_id", F.element_at(names, at + 1).alias("current_type"), F.slice(names, 1, at).alias("locked"), (F.col("n") == len(types)).alias("submitted"))


def option_signature(options: Column) -> Column:
    """Options A to E in order as one text, trimmed; '' for a null map."""
    parts = (F.concat(F.lit(f"{k}:"), F.trim(F.coalesce(F.try_element_at(options, F.lit(k)), F.lit("")))) for k in LETTERS)
    return F.when(options.isNotNull(), F.concat_ws("|", *parts)).otherwise(F.lit(""))


# The letters of sync codes, without those that look alike.
CODE_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def sync_code(seed: Column) -> Column:
    """Ten letters with a hyphen in the middle, from the first ten bytes of the seed's digest; a random seed gives a random code."""
    digest = F.sha2(seed.cast("string"), 256)
    value = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % len(CODE_LETTERS)
    letters = [F.substring(F.lit(CODE_LETTERS), value(i) + 1, F.lit(1)) for i in range(10)]
    return F.concat(*letters[:5], F.lit("-"), *letters[5:])


def sync_hash(code: Column, password: Column) -> Column:
    return F.sha2(F.concat_ws(":", code, password), 256)


def next_version(previous: Column) -> Column:
    """The version of a changed record."""
    return F.coalesce(previous, F.lit(0)) + 1
