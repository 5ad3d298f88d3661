"""Folds over the answer log: clean events, feedback sessions, exams, grading, and the mistake book.

Events are ordered per key by (ts, session_id, seq). Folds are windows and aggregates keyed by question or by session and
question; the largest key holds many events, and windows over it spill by rows, while aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ORDER = ("ts", "session_id", "seq")


def clean_events(log: DataFrame) -> DataFrame:
    """One row for each (session_id, seq), the one received first; letters in upper case. Late rows stay in event-time order."""
    upper = log.withColumn("letter", F.upper("letter"))
    rest = [c for c in upper.columns if c not in ("session_id", "seq")]
    first = upper.groupBy("session_id", "seq").agg(F.min_by(F.struct(*rest), F.struct("received_at", "ts", "question_id", F.coalesce("letter", F.lit("")))).alias("x"))
    return first.select("session_id", "seq", "x.*").select(*log.columns)


def feedback_fold(events: DataFrame, bank: DataFrame, mode: str = "review") -> DataFrame:
    """(session_id, question_id, attempts, first_correct, resolved, last_letter) of a mode with immediate feedback.

    Answers after the first correct one are ignored. Answers to unknown questions are left out.
    """
    w = W.partitionBy("session_id", "question_id").orderBy("ts", "seq")
    rows = events.filter((F.col("mode") == mode) & (F.col("action") == "answer")).join(bank.select(F.col("id").alias("question_id"), "answer"), "question_id")
    rows = rows.withColumn("right", F.coalesce(F.col("letter") == F.col("answer"), F.lit(False)))
    before = F.coalesce(F.max(F.col("right").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = rows.withColumn("done", before).filter("done = 0")
    last = F.struct("ts", "seq")
    return open_.groupBy("session_id", "question_id").agg(
        F.count("*").alias("attempts"), F.min_by("right", last).alias("first_correct"), F.max("right").alias("resolved"), F.max_by("letter", last).alias("last_letter")
    )


def option_results(events: DataFrame, bank: DataFrame, mode: str = "review") -> DataFrame:
    """(session_id, question_id, letter, right): each option tried before the question was resolved, with its result."""
    w = W.partitionBy("session_id", "question_id").orderBy("ts", "seq")
    rows = events.filter((F.col("mode") == mode) & (F.col("action") == "answer") & F.col("letter").isNotNull())
    rows = rows.join(bank.select(F.col("id").alias("question_id"), "answer"), "question_id").withColumn("right", F.col("letter") == F.col("answer"))
    before = F.coalesce(F.max(F.col("right").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("done", before).filter("done = 0").select("session_id", "question_id", "letter", "right").distinct()


def exam_answers(events: DataFrame) -> DataFrame:
    """(session_id, question_id, letter, submitted_at): the last answer to each question before the session's first submission."""
    exam = events.filter("mode = 'exam'")
    submits = exam.filter("action = 'submit'").groupBy("session_id").agg(F.min(F.struct("ts", "seq")).alias("at"))
    rows = exam.filter("action = 'answer'").join(submits, "session_id").filter(F.struct("ts", "seq") < F.col("at"))
    return rows.groupBy("session_id", "question_id", F.col("at.ts").alias("submitted_at")).agg(F.max_by("letter", F.struct("ts", "seq")).alias("letter"))


def grade(papers: DataFrame, answers: DataFrame, bank: DataFrame) -> DataFrame:
    """(session_id, question_id, letter, right, unanswered): every question of every paper (session_id, question_id); a missing answer is wrong."""
    rows = papers.join(answers.select("session_id", "question_id", "letter"), ["session_id", "question_id"], "left")
    rows = rows.join(bank.select(F.col("id").alias("question_id"), "answer"), "question_id", "left")
    right = F.col("letter").eqNullSafe(F.col("answer")) & F.col("letter").isNotNull()
    return rows.select("session_id", "question_id", "letter", right.alias("right"), F.col("letter").isNull().alias("unanswered"))


def grade_totals(graded: DataFrame) -> DataFrame:
    """(session_id, total, correct, wrong, unanswered, wrong_ids), wrong_ids in the order of pos, where there is one, and id."""
    count = lambda c: F.count_if(c)
    keys = [c for c in ("pos", "question_id") if c in graded.columns]
    wrongs = F.collect_list(F.when(~F.col("right"), F.struct(*keys)))  # an exam's questions are few
    return graded.groupBy("session_id").agg(
        F.count("*").alias("total"), count(F.col("right")).alias("correct"), count(~F.col("right")).alias("wrong"), count(F.col("unanswered")).alias("unanswered"),
        F.transform(F.array_sort(wrongs), lambda x: x["question_id"]).alias("wrong_ids"),
    )


def exam_wrongs(graded: DataFrame, submitted: DataFrame) -> DataFrame:
    """(question_id, ts, source, unanswered, kind) events that a graded submission adds to the mistake book."""
    rows = graded.filter(~F.col("right")).join(submitted.select("session_id", "submitted_at").distinct(), "session_id")
    return rows.select("question_id", F.col("submitted_at").alias("ts"), F.lit("exam").alias("source"), "unanswered", F.lit("wrong").alias("kind"), "session_id")


def mistake_events(events: DataFrame, bank: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """(question_id, ts, session_id, seq, kind, source, unanswered) with kind wrong, mark or remove.

    Wrong review answers before the question is resolved, wrong answers of submitted exams, correct answers inside the
    mistake book, and removals. Wrong answers inside the book add nothing. Without papers an exam's questions are those answered.
    """
    key = bank.select(F.col("id").alias("question_id"), "answer")
    w = W.partitionBy("session_id", "question_id").orderBy("ts", "seq")
    review = events.filter("mode = 'review' and action = 'answer'").join(key, "question_id").withColumn("right", F.coalesce(F.col("letter") == F.col("answer"), F.lit(False)))
    before = F.coalesce(F.max(F.col("right").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wrong = review.withColumn("done", before).filter("done = 0 and not right")
    shape = ["question_id", "ts", "session_id", "seq", "kind", "source", "unanswered"]
    parts = [wrong.select("question_id", "ts", "session_id", "seq", F.lit("wrong").alias("kind"), F.lit("review").alias("source"), F.lit(False).alias("unanswered"))]
    answers = exam_answers(events)
    submits = events.filter("mode = 'exam' and action = 'submit'").groupBy("session_id").agg(F.min(F.struct("ts", "seq")).alias("at"))
    papers = answers.select("session_id", "question_id") if papers is None else papers
    graded = grade(papers, answers, bank).join(submits, "session_id").filter(~F.col("right"))
    parts.append(graded.select("question_id", F.col("at.ts").alias("ts"), "session_id", F.col("at.seq").alias("seq"), F.lit("wrong").alias("kind"), F.lit("exam").alias("source"), "unanswered"))
    inside = events.filter("mode = 'wrong-book' and action = 'answer'").join(key, "question_id").filter("letter = answer")
    parts.append(inside.select("question_id", "ts", "session_id", "seq", F.lit("mark").alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("unanswered")))
    removed = events.filter("action = 'remove'")
    parts.append(removed.select("question_id", "ts", "session_id", "seq", F.lit("remove").alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("unanswered")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("question_id is not null").select(*shape)


def mistake_fold(events: DataFrame) -> DataFrame:
    """The mistake book after `events` (as mistake_events gives them), one row per question that is in it.

    A removal ends an entry, the next wrong answer starts another. Marks before the first wrong answer of an entry do nothing;
    a mark stays when the question goes wrong again. Two aggregates and no window over the hot question: the last removal of
    each question, then the events after it.
    """
    at = F.struct(*ORDER)
    rows = events.withColumn("at", at)
    removed = rows.filter("kind = 'remove'").groupBy("question_id").agg(F.max("at").alias("cut"))
    live = rows.filter("kind <> 'remove'").join(removed, "question_id", "left").filter("cut is null or at > cut")
    wrong = F.col("kind") == "wrong"
    first = live.filter(wrong).groupBy("question_id").agg(
        F.min("at").alias("first"), F.count("*").alias("wrong_count"), F.max(F.col("source") == "review").alias("review"), F.max(F.col("source") == "exam").alias("exam"),
        F.max_by("source", "at").alias("last_source"), F.max_by("unanswered", "at").alias("last_unanswered"), F.max("ts").alias("last_wrong"),
    )
    marks = live.filter("kind = 'mark'").select("question_id", "at").join(first.select("question_id", "first"), "question_id").filter("at > first")
    marked = marks.groupBy("question_id").agg(F.max("at.ts").alias("correct_at"))
    book = first.join(marked, "question_id", "left")
    return book.select(
        "question_id", "review", "exam", "wrong_count", "last_source", "last_unanswered", F.col("correct_at").isNotNull().alias("correct_in_book"), "correct_at",
        F.col("first.ts").alias("created_at"), F.greatest("last_wrong", "correct_at").alias("updated_at"),
    )


def normalise_book(book: DataFrame) -> DataFrame:
    """The stored mistake book with defaults: counts of 1 at least, null flags false, correct_at only where correct."""
    correct = F.coalesce("correct_in_book", F.lit(False))
    return book.filter("question_id is not null").select(
        "question_id", F.coalesce("sources.review", F.lit(False)).alias("review"), F.coalesce("sources.exam", F.lit(False)).alias("exam"),
        F.greatest(F.lit(1), F.coalesce("wrong_count", F.lit(1))).alias("wrong_count"), "last_source", F.coalesce("last_unanswered", F.lit(False)).alias("last_unanswered"),
        correct.alias("correct_in_book"), F.when(correct, F.col("correct_at")).alias("correct_at"), "created_at", "updated_at",
    )


def needs_confirmation(book: DataFrame) -> DataFrame:
    """(question_id, confirm): whether removing an entry has to be confirmed, because it isn't correct yet."""
    return normalise_book(book).select("question_id", (~F.col("correct_in_book")).alias("confirm"))


def valid_sessions(events: DataFrame, bank: DataFrame) -> DataFrame:
    """(session_id, valid): whether the bank has every question a session refers to."""
    known = bank.select(F.col("id").alias("question_id"), F.lit(True).alias("known"))
    rows = events.filter("question_id is not null").select("session_id", "question_id").distinct().join(known, "question_id", "left")
    return rows.groupBy("session_id").agg((F.count("known") == F.count("*")).alias("valid"))
