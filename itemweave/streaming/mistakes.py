"""The mistake book as a stream: keyed state, one entry per question, updated in event order within each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = (
    "question_id string, present boolean, review boolean, exam boolean, wrong_count long, last_source string, last_unanswered boolean, "
    "correct_in_book boolean, correct_at timestamp, created_at timestamp, updated_at timestamp"
)
STATE = (
    "review boolean, exam boolean, wrong_count long, last_source string, last_unanswered boolean, correct_at timestamp, created_at timestamp, updated_at timestamp"
)


def step(entry: tuple | None, kind: str, source: str | None, unanswered: bool, at) -> tuple | None:
    """The entry after one event: wrong adds or counts, mark sets correct_at of an existing entry, remove ends it."""
    if kind == "remove":
        return None
    if kind == "mark":
        return entry and (*entry[:5], at, entry[6], at)
    old = entry or (False, False, 0, None, False, None, at, at)
    return (old[0] or source == "review", old[1] or source == "exam", old[2] + 1, source, unanswered, old[5], old[6], at)


def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entry = state.get if state.exists else None
    none = lambda x: None if pd.isna(x) else x
    entry = entry and tuple(none(x) for x in entry)
    rows = pd.concat(list(frames)).sort_values(["ts", "session_id", "seq"], kind="stable")
    for r in rows.itertuples():
        entry = step(entry, r.kind, none(r.source), bool(r.unanswered), r.ts.to_pydatetime())
    if entry is None:
        if state.exists:
            state.remove()
        out = (key[0], False, *[None] * 9)
    else:
        state.update(entry)
        out = (key[0], True, *entry[:5], entry[5] is not None, *entry[5:])
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    yield pd.DataFrame([out], columns=names)


def mistake_book_stream(events: DataFrame) -> DataFrame:
    """A streaming frame with each touched question's entry after every micro-batch; present is false after a removal.

    `events` as operators.events.mistake_events gives them, as a stream with ts as timestamp. State is one small row per
    question in the book, so it is bounded by the bank, not by the log; write the result in update mode.
    """
    return events.groupBy("question_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def dedup_stream(log: DataFrame, delay: str = "30 days") -> DataFrame:
    """The raw log without repeated (session_id, seq), remembered for `delay` of event time."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "seq"])
