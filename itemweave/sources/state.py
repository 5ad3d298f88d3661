"""Application state as tables: one long form of keyed records, and backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
COLLECTIONS = ("attempts", "wrongs", "favorites", "important", "later", "knowledge", "sessions", "exams")
BACKUP_FORMAT = 1
BOOK_VERSION = 1


def records(states: DataFrame) -> DataFrame:
    """(device, collection, key, version, updated_at, payload) from states (device, state as JSON text), one row per record.

    The key is id, else questionId, else recordId; records without one are dropped.
    """
    parts = F.array(*(F.struct(F.lit(c).alias("collection"), F.from_json(F.get_json_object("state", f"$.{c}"), "map<string,string>").alias("entries")) for c in COLLECTIONS))
    rows = states.select("device", F.explode(parts).alias("p")).select("device", "p.collection", F.explode("p.entries").alias("name", "payload"))
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    rows = rows.select("device", "collection", F.coalesce(get("id"), get("questionId"), get("recordId")).alias("key"), get("version").cast("int").alias("version"), get("updatedAt").alias("updated_at"), "payload")
    return rows.filter("key is not null")


def redacted(state: Column) -> Column:
    """The state wrapped for export with format and version; any object at its top loses its field passwordHash.

    The text is read as JSON and written anew, so no quote inside a value can end it early. Null and broken texts give null.
    """
    whole = F.from_json(state, "map<string,variant>")

    def clean(_: Column, value: Column) -> Column:
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        held = F.schema_of_variant(value).startswith("OBJECT") & F.coalesce(F.map_contains_key(fields, "passwordHash"), F.lit(False))
        return F.when(held, F.to_variant_object(F.map_filter(fields, lambda k, _: k != "passwordHash"))).otherwise(value)

    return F.concat(F.lit(f'{{"format":{BACKUP_FORMAT},"state":'), F.to_json(F.transform_values(whole, clean)), F.lit("}"))


def book_entries(states: DataFrame) -> DataFrame:
    """(device, question_id, review, exam, wrong_count, correct_in_book, correct_at) of the mistake book in (device, state).

    A book of another version than BOOK_VERSION is empty; entries whose key isn't their questionId are dropped. Counts are 1 at
    least, missing flags false, correct_at only where correct.
    """
    book = F.when(F.get_json_object("state", "$.wrongBook.version") == str(BOOK_VERSION), F.get_json_object("state", "$.wrongBook.entries"))
    rows = states.select("device", F.explode(F.from_json(book, "map<string,string>")).alias("name", "entry"))
    get = lambda k: F.get_json_object("entry", f"$.{k}")
    correct = F.coalesce(get("correctInWrongBook") == "true", F.lit(False))
    return rows.filter(get("questionId") == F.col("name")).select(
        "device", F.col("name").alias("question_id"), F.coalesce(get("sources.review") == "true", F.lit(False)).alias("review"), F.coalesce(get("sources.exam") == "true", F.lit(False)).alias("exam"),
        F.greatest(F.lit(1), F.coalesce(get("wrongCount").try_cast("int"), F.lit(1))).alias("wrong_count"), correct.alias("correct_in_book"), F.when(correct, get("correctAt")).alias("correct_at"),
    )


def valid_backup(payload: Column) -> Column:
    return F.coalesce((F.get_json_object(payload, "$.format") == str(BACKUP_FORMAT)) & F.get_json_object(payload, "$.state").isNotNull(), F.lit(False))
