"""Sessions and exams that may be resumed: their versions have to be current and the bank has to have all their questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.operators.skew import small

#: Banks of so many items are looked up by broadcast.
BROADCAST_ITEMS = 1_000_000


def compatible(version: Column, current: str, earlier: list[str]) -> Column:
    """Whether a bank version is the current one or one of those it can still read; null is not."""
    return F.coalesce(version.isin(current, *earlier), F.lit(False))


def resumable(sessions: DataFrame, bank: DataFrame, versions: dict[str, dict[str, str]], subject_versions: list[str]) -> DataFrame:
    """(session_id, reason): reason is null for a session that may be resumed, else the first test it fails.

    sessions: (session_id, mode, bank_version, paper_format_version, blueprint_version, source, subject_id, subject_bank_version,
    question_ids). `versions` has, for each mode, the value that each version column must have. Sessions of source 'subject' need a
    subject version out of `subject_versions` and questions of their subject only. Every session needs all its questions.
    Reasons in order: mode, version, subject-version, subject, question. Null ids are unknown questions; no questions are fine.
    """
    fits = F.lit(False)
    for mode, wanted in versions.items():
        same = F.lit(True)
        for column, value in wanted.items():
            same = same & F.col(column).eqNullSafe(F.lit(value))
        fits = fits | ((F.col("mode") == mode) & same)
    known = small(bank.select(F.col("id").alias("q"), F.col("subject_id").alias("of"), F.lit(True).alias("known")), BROADCAST_ITEMS)
    asked = sessions.select("session_id", "subject_id", F.explode("question_ids").alias("q")).join(known, "q", "left")
    checks = asked.groupBy("session_id").agg(
        F.bool_and(F.coalesce("known", F.lit(False))).alias("whole"), F.bool_and(F.coalesce(F.col("of") == F.col("subject_id"), F.lit(False))).alias("own")
    )
    rows = sessions.select("session_id", "mode", fits.alias("fits"), "source", "subject_bank_version").join(checks, "session_id", "left")
    subject = F.coalesce(F.col("source") == "subject", F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("mode").isin(*versions), F.lit(False)), "mode").when(~F.coalesce("fits", F.lit(False)), "version")
        .when(subject & ~F.coalesce(F.col("subject_bank_version").isin(*subject_versions), F.lit(False)), "subject-version")
        .when(subject & ~F.coalesce("own", F.lit(True)), "subject").when(~F.coalesce("whole", F.lit(True)), "question")
    )
    return rows.select("session_id", reason.alias("reason"))
