import datetime as dt
import random

import pandas as pd

from itemweave.operators import events
from itemweave.streaming import mistakes

LOG = "session_id string, seq long, ts timestamp_ntz, received_at timestamp_ntz, mode string, question_id string, action string, letter string"
T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    full = [(s, n, T0 + dt.timedelta(minutes=m), T0 + dt.timedelta(minutes=m + late), mode, q, a, x) for s, n, m, late, mode, q, a, x in rows]
    return spark.createDataFrame(full, LOG)


def bank(spark, **answers):
    return spark.createDataFrame(list(answers.items()), "id string, answer string")


def test_clean_events_keeps_the_first_received(spark):
    df = log(spark, [("s", 1, 0, 5, "review", "q", "answer", "b"), ("s", 1, 0, 1, "review", "q", "answer", "a"), ("s", 2, 1, 0, "review", "q", "answer", None)])
    assert [(r.seq, r.letter) for r in events.clean_events(df).orderBy("seq").collect()] == [(1, "A"), (2, None)]
    assert events.clean_events(df.limit(0)).count() == 0


def test_feedback_ignores_answers_after_the_right_one(spark):
    df = log(spark, [("s", i, i, 0, "review", "q", "answer", x) for i, x in enumerate(["B", None, "A", "C"])])
    row = events.feedback_fold(df, bank(spark, q="A")).first()
    assert (row.attempts, row.first_correct, row.resolved, row.last_letter) == (3, False, True, "A")
    assert {(r.letter, r.right) for r in events.option_results(df, bank(spark, q="A")).collect()} == {("B", False), ("A", True)}


def test_exam_of_150(spark):
    rows = [("e", 1, 0, 0, "exam", "q0", "answer", "B"), ("e", 2, 1, 0, "exam", "q0", "answer", "A"), ("e", 3, 2, 0, "exam", "q1", "answer", "C"), ("e", 4, 3, 0, "exam", None, "submit", None), ("e", 5, 4, 0, "exam", "q2", "answer", "A")]
    df, key = log(spark, rows), bank(spark, **{f"q{i}": "A" for i in range(150)})
    papers = spark.createDataFrame([("e", f"q{i}") for i in range(150)], "session_id string, question_id string")
    graded = events.grade(papers, events.exam_answers(df), key)
    t = events.grade_totals(graded).first()
    assert (t.total, t.correct, t.wrong, t.unanswered) == (150, 1, 149, 148)
    book = events.mistake_fold(events.mistake_events(df, key, papers)).collect()
    assert len(book) == 149 and {r.wrong_count for r in book} == {1} and sum(r.last_unanswered for r in book) == 148


def brute(rows):
    entry = None
    for kind, source, at in rows:
        entry = mistakes.step(entry, kind, source, False, at)
    return entry


def test_mistake_fold_batch_and_stream_agree_with_the_steps(spark, tmp_path):
    rng, rows, want = random.Random(5), [], {}
    for q in range(40):
        mine = []
        for n in range(rng.randint(1, 12)):
            at = T0 + dt.timedelta(minutes=rng.randint(0, 10**6))
            kind = rng.choice(["wrong", "wrong", "mark", "remove"])
            mine.append((f"q{q}", at, f"s{q}", n, kind, rng.choice(["review", "exam"]) if kind == "wrong" else None, False))
        rows += mine
        entry = brute([(r[4], r[5], r[1]) for r in sorted(mine, key=lambda r: r[1])])
        if entry:
            want[f"q{q}"] = (*entry[:5], entry[5] is not None, *entry[5:])
    schema = "question_id string, ts timestamp_ntz, session_id string, seq long, kind string, source string, unanswered boolean"
    df = spark.createDataFrame(rows, schema)
    assert {r.question_id: tuple(r)[1:] for r in events.mistake_fold(df).collect()} == want
    src = str(tmp_path / "in")
    df.selectExpr("question_id", "cast(ts as timestamp) ts", "session_id", "seq", "kind", "source", "unanswered").repartition(1).write.parquet(src)
    stream = spark.readStream.schema(schema.replace("timestamp_ntz", "timestamp")).parquet(src)
    out = mistakes.mistake_book_stream(stream).writeStream.outputMode("update").format("memory").queryName("book").option("checkpointLocation", str(tmp_path / "ck")).start()
    out.processAllAvailable()
    out.stop()
    got = {r.question_id: tuple(r)[2:] for r in spark.table("book").filter("present").collect()}
    assert got == want


def test_streamed_state_survives_batches():
    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, v):
            self.exists, self.value = True, v

        def remove(self):
            self.exists, self.value = False, None

    s, at = State(), pd.Timestamp("2024-01-01")
    frame = lambda kind, n: pd.DataFrame([("q", at, "s", n, kind, "review" if kind == "wrong" else None, False)], columns="question_id ts session_id seq kind source unanswered".split())
    assert next(mistakes.update(("q",), iter([frame("mark", 0)]), s)).iloc[0].present == False  # noqa: E712
    assert next(mistakes.update(("q",), iter([frame("wrong", 1)]), s)).iloc[0].wrong_count == 1
    row = next(mistakes.update(("q",), iter([frame("mark", 2), frame("wrong", 3)]), s)).iloc[0]
    assert row.wrong_count == 2 and row.correct_in_book
    assert not next(mistakes.update(("q",), iter([frame("remove", 4)]), s)).iloc[0].present and not s.exists


def test_book_defaults(spark):
    df = spark.sql("""select 'a' question_id, named_struct('review', true, 'exam', cast(null as boolean)) sources, cast(null as int) wrong_count, 'exam' last_source, cast(null as boolean) last_unanswered,
      cast(null as boolean) correct_in_book, timestamp_ntz'2024-01-01 00:00:00' correct_at, timestamp_ntz'2024-01-01 00:00:00' created_at, timestamp_ntz'2024-01-01 00:00:00' updated_at""")
    r = events.normalise_book(df).first()
    assert (r.review, r.exam, r.wrong_count, r.last_unanswered, r.correct_in_book, r.correct_at) == (True, False, 1, False, False, None)
    assert events.needs_confirmation(df).first().confirm
    v = {r.session_id: r.valid for r in events.valid_sessions(log(spark, [("s", 1, 0, 0, "exam", "q", "answer", "A"), ("t", 1, 0, 0, "exam", "zz", "answer", "A")]), bank(spark, q="A")).collect()}
    assert v == {"s": True, "t": False}
