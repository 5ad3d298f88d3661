"""The queries over the reference's own operators, by name, with their SQL where DuckDB can run it on whole tables.

bank_ord, the place of an item in its bank, is the rank of (imported_at, id) wherever a query needs an order.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemweave import schema
from itemweave.functions import text as X
from itemweave.operators import bank, dedup, events, fusion, lookup, merge, paper, patches, quality, scanned_bank, sequence, validate
from itemweave.session import written
from itemweave.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "exam_paper_pages"
SEED = 7


def _folding() -> tuple[str, str]:
    """Two strings for SQL's translate: every character of the usual blocks that compatibility folding turns into one other, and that one."""
    blocks = (range(0x80, 0x500), range(0x2000, 0x3400), range(0xF900, 0xFB00), range(0xFF00, 0xFFF0))
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for b in blocks for c in b]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1 and b != "'"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_EDGE = r"[\s\x0B\x{85}\p{Z}\x{FEFF}]+"


def _trim(c: str) -> str:
    """SQL: without white space of any kind at both ends, null as ''."""
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '^{_EDGE}', ''), '{_EDGE}$', '')"


def _nfkc(c: str) -> str:
    """SQL: compatibility folding. The two characters of the tables that fold into several are spelled out."""
    a, b = _folding()
    return f"nfc_normalize(replace(replace(translate({c}, '{a}', '{b}'), '℃', '°C'), '…', '...'))"


def _on(*tables: str, sql: str | None = None):
    """Register a function of tables as the query of its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _ordered(questions: DataFrame) -> DataFrame:
    """bank_ord: microseconds of import and a digest of id, so an order without a global sort; ties fall by digest."""
    micros = F.unix_micros(F.col("imported_at").cast("timestamp"))
    return questions.withColumn("bank_ord", F.struct(micros.alias("t"), F.col("id").alias("i")))


# ---- profiles, projections, filters


@_on("questions", sql="""
select unit, type, count(*) as items, count(distinct group_id) as groups, count(group_id) as grouped,
  count(*) filter (where trim(coalesce(explanation, '')) <> '') as explained from questions group by unit, type""")
def bank_profile(q):
    return q.groupBy("unit", "type").agg(
        F.count("*").alias("items"), F.count_distinct("group_id").alias("groups"), F.count("group_id").alias("grouped"),
        F.count_if(F.trim(F.coalesce("explanation", F.lit(""))) != "").alias("explained"),
    )


@_on("questions", sql="""
select cast(regexp_extract(id, '^(\\d{4})(-|$)', 1) as integer) as year, type, count(*) as items from questions group by all""")
def year_type_counts(q):
    return q.groupBy(X.year_of(F.col("id")).alias("year"), "type").agg(F.count("*").alias("items"))


@_on("questions", sql="""
select case when grouping(unit) = 1 then -1 else unit end as unit, count(*) filter (where type = 'A1/A2') as a12, count(*) filter (where type = 'A3') as a3,
  count(*) filter (where type = 'B1') as b1 from questions group by rollup(unit)""")
def type_pivot(q):
    """Items by unit and type, pivoted, with a total row (unit -1)."""
    counted = q.rollup("unit").agg(*(F.count_if(F.col("type") == t).alias(n) for t, n in zip(schema.TYPES, ("a12", "a3", "b1"))), F.grouping("unit").alias("g"))
    return counted.select(F.when(F.col("g") == 1, -1).otherwise(F.col("unit")).cast("int").alias("unit"), "a12", "a3", "b1")


@_on("questions", sql="select id, unit, type, number from questions where unit = 1 and type = 'B1'")
def stratum_filter(q):
    return q.filter((F.col("unit") == 1) & (F.col("type") == "B1")).select("id", "unit", "type", "number")


_CELLS = " union all ".join(
    f"select id, '{n}' as field, '{g}' as field_group, {c} as text from questions where {c} is not null"
    for n, g, c in [
        ("stem", "stem", "stem"), ("explanation", "explanation", "explanation"), ("prompt", "stem", "prompt"), ("shared_stem", "stem", "shared_stem"),
        *((f"option-{k}", "option", f"options['{k}']") for k in schema.LETTERS), *((f"shared-option-{k}", "option", f"shared_options['{k}']") for k in schema.LETTERS),
    ]
)


@_on("questions", sql=f"""
select field, field_group, count(*) as n, cast(sum(length(text)) as bigint) as chars, count(*) filter (where trim(text) = '') as blank
from ({_CELLS}) group by field, field_group""")
def unpivot_fields(q):
    rows = bank.text_fields(q)
    return rows.groupBy("field", "field_group").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.trim("text") == "").alias("blank")
    )


@_on("questions", "subjects", sql="""
select s.ord, s.subject_id, s.subject_name, count(q.id) as items, count(distinct q.unit) as units from subjects s left join questions q using (subject_id)
group by s.ord, s.subject_id, s.subject_name""")
def subject_profile(q, s):
    counts = q.groupBy("subject_id").agg(F.count("*").alias("items"), F.count_distinct("unit").alias("units"))
    joined = s.join(counts, "subject_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select("ord", "subject_id", "subject_name", F.coalesce("items", zero).alias("items"), F.coalesce("units", zero).alias("units"))


@_on("subjects", sql="select subject_name, 'subject-' || substr(sha256(regexp_replace(source_file_name, '\\.[^.]*$', '')), 1, 12) as derived_id from subjects")
def subject_ids(s):
    return s.select("subject_name", X.subject_id(files.source_name("source_file_name")).alias("derived_id"))


@_on("questions", sql="""
select subject_id, unit, type, count(*) as items from questions where subject_id is not null group by all""")
def knowledge_tree(q):
    """Subject -> unit -> types with their numbers, exploded."""
    nested = q.filter("subject_id is not null").groupBy("subject_id", "unit", "type").agg(F.count("*").alias("items"))
    tree = nested.groupBy("subject_id").agg(F.collect_list(F.struct("unit", "type", "items")).alias("branches"))
    return tree.select("subject_id", F.explode("branches").alias("b")).select("subject_id", "b.unit", "b.type", "b.items")


@_on("questions", "bank_sources", sql="""
select q.source, b.kind, b.lang, count(*) as items, count(*) filter (where imported_at >= make_timestamp(b.year + 1, 1, 1, 0, 0, 0.0)) as late
from questions q join bank_sources b using (source) group by all""")
def source_profile(q, b):
    late = F.col("imported_at") >= F.make_timestamp_ntz(F.col("year") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return q.join(b, "source").groupBy("source", "kind", "lang").agg(F.count("*").alias("items"), F.count_if(late).alias("late"))


@_on("questions", sql="""
select id, case when length(t) > 240 then substr(t, 1, 237) || '...' else t end as excerpt from
(select id, trim(regexp_replace(regexp_replace(explanation, '[\\s\\x0B\\x{85}\\p{Z}\\x{FEFF}]+', ' ', 'g'), '^ | $', '', 'g')) as t from questions where explanation is not null)""")
def excerpts(q):
    folded = F.regexp_replace(F.col("explanation"), r"[\x{FEFF}]+", " ")
    return q.filter("explanation is not null").select("id", X.excerpt(folded).alias("excerpt"))


# ---- identity and set operations


_BARE = "regexp_replace(coalesce({}, ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')"
_FP = "sha256(array_to_string([" + ", ".join([_BARE.format("stem"), *(_BARE.format(f"options['{k}']") for k in schema.LETTERS)]) + "], chr(31)))"


@_on("questions", sql=f"""
with q as (select id, epoch_us(imported_at) as t, {_FP} as fp from questions)
select id, first_value(id) over (partition by fp order by t, id) as first_id, row_number() over (partition by fp order by t, id) > 1 as duplicate from q""")
def dedup_keep_first(q):
    rows = dedup.keep_first(_ordered(q), X.item_fingerprint(F.col("stem"), F.col("options")), "bank_ord")
    return rows.select("id", "first_id", "duplicate")


def _lines(*columns: str) -> str:
    """SQL: texts in one, apart by a character that folding leaves alone."""
    return " || chr(30) || ".join(f"coalesce({c}, '')" for c in columns)


_OPTIONS = [f"options['{k}']" for k in schema.LETTERS]
_CONTENT = rf"lower(regexp_replace({_nfkc('stem || ' + ' || '.join(f'coalesce({c}, chr(30))' for c in _OPTIONS))}, '[^0-9A-Za-z\x{{3400}}-\x{{9FFF}}]', '', 'g'))"
_FIRSTS = "select id, first_id from (select id, key, first_value(id) over w as first_id, row_number() over w as n from k window w as (partition by key order by t, id)) where n > 1 and key <> ''"


@_on("questions", sql=f"with k as (select id, epoch_us(imported_at) as t, {_CONTENT} as key from questions where stem is not null) {_FIRSTS}")
def dedup_nfkc_keep_first(q):
    """As dedup_keep_first with the folded key: NFKC, letters and ideographs."""
    key = F.concat(X.trimmed(F.col("stem")), *(F.coalesce(F.try_element_at("options", F.lit(k)), F.lit("")) for k in schema.LETTERS))
    return dedup.keep_first(_ordered(q), F.md5(X.content_key(key)), "bank_ord").filter("duplicate").select("id", "first_id")


@_on("questions", sql=rf"with k as (select id, epoch_us(imported_at) as t, regexp_replace(lower({_nfkc('stem')}), '[^\p{{L}}\p{{N}}]', '', 'g') as key from questions where stem is not null) {_FIRSTS}")
def dedup_stem_keep_first(q):
    """Keep the first of equal stems under the alphanumeric key."""
    return dedup.keep_first(_ordered(q), X.alnum_key(F.col("stem")), "bank_ord").filter("duplicate").select("id", "first_id")


@_on("questions", sql=f"""
select first_id, n from (select {_FP} as fp, min(id) as first_id, count(*) as n from questions group by 1) where n > 1""")
def residual_duplicates(q):
    rows = q.withColumn("fp", X.item_fingerprint(F.col("stem"), F.col("options")))
    return dedup.residual_duplicates(rows, "fp").select("first_id", "n")


_FULL = f"sha256(array_to_string([{_FP}, coalesce(answer, ''), {_BARE.format('explanation')}], chr(31)))"


@_on("questions", sql=f"""
with q as (select coalesce(nullif(group_id, ''), id) as block, epoch_us(imported_at) as t, id, {_FULL} as fp from questions),
b as (select block, list_sort(list(fp)) as bag, min(struct_pack(t := t, i := id)) as o from q group by block)
select block, first_value(block) over (partition by bag order by o) as kept_block from b""")
def block_dedup(q):
    fp = F.sha2(F.concat_ws("\x1f", X.item_fingerprint(F.col("stem"), F.col("options")), F.coalesce("answer", F.lit("")), F.regexp_replace(F.coalesce("explanation", F.lit("")), r"\s+", "")), 256)
    rows = _ordered(q).withColumns({"fp": fp, "block": F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("id"))})
    return dedup.block_dedup(rows, "fp", "block", "bank_ord")


@_on("questions", sql=f"""
with recursive k as (select coalesce(nullif(group_id, ''), id) as block, epoch_us(imported_at) as t, id, {_CONTENT} as key from questions),
b as (select block, row_number() over (order by min(struct_pack(t := t, i := id))) as n, list(distinct key) filter (where key <> '') as keys from k group by block),
often as (select list(key) as all_keys from (select key from k where key <> '' group by key having count(distinct block) > 1)),
d as (select block, n, list_intersect(keys, all_keys) as keys from b, often),
c as (select block, row_number() over (order by n) as n, keys from d where len(keys) > 0),
walk(n, block, seen, dropped) as (select 0::bigint, '', []::varchar[], false union all
  select c.n, c.block, case when list_has_any(w.seen, c.keys) then w.seen else list_concat(w.seen, c.keys) end, list_has_any(w.seen, c.keys) from walk w join c on c.n = w.n + 1)
select block from walk where dropped""")
def sequential_block_dedup(q):
    """Blocks dropped because of a key that an accepted earlier block had; the SQL walks the blocks one by one."""
    key = F.concat(X.trimmed(F.col("stem")), *(F.coalesce(F.try_element_at("options", F.lit(k)), F.lit("")) for k in schema.LETTERS))
    rows = _ordered(q).withColumns({"key": F.md5(X.content_key(key)), "block": F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("id"))})
    rows = rows.withColumn("ord", F.concat_ws("|", F.lpad(F.col("bank_ord.t").cast("string"), 20, "0"), "id"))
    return dedup.sequential_block_dedup(rows, "key", "block", "ord").filter("dropped").select("block")


@_on("questions", sql=rf"""
with f as (select id, answer, string_split(regexp_replace({_nfkc(_lines(*(_trim(c) for c in ("stem", *_OPTIONS))))}, '[^0-9A-Za-z\x{{3400}}-\x{{9FFF}}\x{{1E}}]', '', 'g'), chr(30)) as t from questions),
k as (select id, lower(t[1]) || '|' || array_to_string(list_sort(list_transform(t[2:6], lambda x: lower(x))), '|') as key,
  case when trim(answer) in ('A', 'B', 'C', 'D', 'E') then lower(t[ascii(trim(answer)) - 63]) else '' end as right_text from f)
select min(id) as first_id, count(*) as members, count(distinct right_text) as answers from k group by key having count(*) > 1 and count(distinct right_text) > 1""")
def conflicting_answers(q):
    return quality.answer_conflicts(q)


_LOOSE = r"[\s\x0B\x{85}\p{Z}\x{FEFF}，。；：、（）()《》\"“”‘’？?！!]+"
_LOOSED = rf"""loosed as (select id, answer, group_id, string_split(regexp_replace({_nfkc(_lines(*(_trim(c) for c in ("explanation", "stem", *_OPTIONS))))}, '{_LOOSE}', '', 'g'), chr(30)) as t from questions)"""


@_on("questions", sql=rf"""
with {_LOOSED}, k as (select id, array_to_string(t[2:7], chr(30)) as key, case when answer in ('A', 'B', 'C', 'D', 'E') then t[ascii(answer) - 62] else '' end as right_text from loosed)
select min(id) as first_id, count(*) as members, count(distinct right_text) as answers from k group by key having count(*) > 1 and count(distinct right_text) > 1""")
def duplicate_answer_conflicts(q):
    return quality.duplicate_answer_conflicts(q)


@_on("questions", "bank_sources", sql=f"""
with q as (select {_FP} as fp, b.kind from questions q join bank_sources b using (source))
select a.kind, count(distinct a.fp) as shared from q a where a.kind <> 'docx' and a.fp in (select fp from q where kind = 'docx') group by a.kind""")
def bank_overlap(q, b):
    """How many distinct items of each other kind of source the document bank has too."""
    rows = q.join(b.select("source", "kind"), "source").select("kind", X.item_fingerprint(F.col("stem"), F.col("options")).alias("fp")).distinct()
    docs = rows.filter("kind = 'docx'").select("fp")
    return rows.filter("kind <> 'docx'").join(docs, "fp", "left_semi").groupBy("kind").agg(F.count("*").alias("shared"))


@_on("questions", "answer_log", sql="select distinct question_id from answer_log where question_id is not null and question_id not in (select id from questions)")
def missing_keys(q, log):
    return log.filter("question_id is not null").select("question_id").distinct().join(q.select(F.col("id").alias("question_id")), "question_id", "left_anti")


@_on("questions", "mistake_book", sql="""
with found as (select id from questions where trim(coalesce(explanation, '')) = ''), reviewed as (select question_id as id from mistake_book where wrong_count >= 3)
(select id, 'found' as side from found except select id, 'found' from reviewed) union all (select id, 'reviewed' from reviewed except select id, 'reviewed' from found)""")
def candidate_set_difference(q, book):
    found = q.filter(F.trim(F.coalesce("explanation", F.lit(""))) == "")
    return dedup.symmetric_difference(found, book.filter("wrong_count >= 3").select(F.col("question_id").alias("id")))


@_on("questions", sql="""
select id, array_to_string(list_sort(list_distinct(['A','B','C','D','E'])), '') as expected,
  array_to_string(list_filter(['A','B','C','D','E'], lambda k: trim(coalesce(options[k], '')) = ''), '') as missing
from questions where len(list_filter(['A','B','C','D','E'], lambda k: trim(coalesce(options[k], '')) = '')) > 0""")
def missing_options(q):
    letters = F.array(*(F.lit(k) for k in schema.LETTERS))
    missing = F.filter(letters, lambda k: F.trim(F.coalesce(F.try_element_at("options", k), F.lit(""))) == "")
    return q.select("id", F.lit("ABCDE").alias("expected"), F.array_join(missing, "").alias("missing")).filter("missing <> ''")


# ---- corrections and merges


_STATUS = f"""
with cells as ({_CELLS}),
p as (select *, row_number() over (partition by id, field order by patch_id) as turn from patches),
s as (select p.*, case when p.id not in (select id from questions) then 'unknown-id'
    when p.field is null or not (p.field in ('stem', 'explanation', 'prompt', 'shared_stem') or regexp_matches(p.field, '^(shared-)?option-[A-E]$')) then 'unknown-field'
    when p.turn > 1 then 'duplicate' when p.before is distinct from c.text then 'changed' else 'ok' end as status
  from p left join cells c on c.id = p.id and c.field = p.field)"""


@_on("questions", "patches", sql=_STATUS + " select patch_id, id, field, status from s")
def patch_status(q, p):
    return patches.patch_status(q, p).select("patch_id", "id", "field", "status")


@_on("questions", "patches", sql=_STATUS + """, ok as (select id, field, after from s where status = 'ok')
select c.id, c.field, o.after as text from cells c join ok o on o.id = c.id and o.field = c.field where o.after is distinct from c.text""")
def patched_fields(q, p):
    """The fields that differ after all fitting patches."""
    new = bank.text_fields(patches.apply_patches(q, p, strict=False)).select("id", "field", "text")
    old = bank.text_fields(q).select("id", "field", F.col("text").alias("old"))
    return new.join(old, ["id", "field"]).filter(~F.col("text").eqNullSafe(F.col("old"))).select("id", "field", "text")


_REPLICA = """
local as (select 'mistakes' as collection, question_id as key, wrong_count as version, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') as updated_at, 'local' as payload
  from mistake_book where sources.review),
remote as (select 'mistakes' as collection, question_id as key, case when last_source = 'exam' then wrong_count + 1 when last_unanswered then null else wrong_count end as version,
  strftime(coalesce(correct_at, updated_at), '%Y-%m-%dT%H:%M:%S') as updated_at, 'remote' as payload from mistake_book where sources.exam or correct_in_book)"""


@_on("mistake_book", sql=f"""
with {_REPLICA}, r as (select *, 1 as held from local union all select *, 0 from remote),
o as (select *, row_number() over (partition by collection, key order by coalesce(version, 0) desc, coalesce(updated_at, '') desc, held desc) as n from r)
select collection, key, version, updated_at, payload from o where n = 1""")
def lww_merge(book):
    """The book as two devices hold it, one that reviews and one that sits exams and marks, merged."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    shape = lambda df, v, u, p: df.select(F.lit("mistakes").alias("collection"), F.col("question_id").alias("key"), v.cast("int").alias("version"), iso(u).alias("updated_at"), F.lit(p).alias("payload"))
    local = shape(book.filter("sources.review"), F.col("wrong_count"), F.col("updated_at"), "local")
    version = F.when(F.col("last_source") == "exam", F.col("wrong_count") + 1).when(~F.coalesce("last_unanswered", F.lit(False)), F.col("wrong_count"))
    remote = shape(book.filter("sources.exam or correct_in_book"), version, F.coalesce("correct_at", "updated_at"), "remote")
    return merge.merge_replicas(local, remote)


# ---- sequences and groups


@_on("questions", sql="""
with g as (select group_id, count(*) as members, min(group_start) as declared_start, max(group_end) as declared_end, list_sort(list(number)) as numbers,
  count(distinct group_start) + count(distinct group_end) = 2 as agreed from questions where coalesce(group_id, '') <> '' group by group_id)
select group_id, members, declared_start, declared_end,
  coalesce(agreed and declared_start <= declared_end and numbers = generate_series(declared_start, declared_end), false) as complete from g""")
def group_range_complete(q):
    return sequence.group_ranges(q)


@_on("questions", sql="""
with p as (select id, group_id, row_number() over (order by epoch_us(imported_at), id) as pos from questions),
s as (select group_id, pos - lag(pos) over (partition by group_id order by pos) as step from p where coalesce(group_id, '') <> '')
select group_id, bool_and(coalesce(step, 1) = 1) as contiguous from s group by group_id""")
def group_contiguity(q):
    """Whether the members stand side by side in the bank."""
    return sequence.group_contiguity(_ordered(q), "bank_ord")


@_on("questions", sql="""
with p as (select id, group_id, row_number() over (order by unit, number, id) as pos from questions),
s as (select group_id, pos - lag(pos) over (partition by group_id order by pos) as step from p where coalesce(group_id, '') <> '')
select group_id, bool_and(coalesce(step, 1) = 1) as contiguous from s group by group_id""")
def group_contiguity_by_number(q):
    """The same with the bank in the order of unit and number."""
    return sequence.group_contiguity(q.withColumn("place", F.struct("unit", "number")), "place")


@_on("questions", sql=f"""
with r as (select *, coalesce(trim(shared_stem), '') as ss, case when shared_options is null then '' else array_to_string(
  [{", ".join(f"'{k}:' || coalesce(trim(shared_options['{k}']), '')" for k in schema.LETTERS)}], '|') end as so,
  coalesce(regexp_extract(id, '^(\\d{{4}})(-|$)', 1), '') as year from questions where coalesce(group_id, '') <> ''),
g as (select group_id, count(distinct type) as types, arg_min(type, struct_pack(n := number, i := id)) as type, count(distinct year) as years, count(distinct coalesce(unit, -1)) as units,
  count(distinct ss) as stems, min(ss) as stem, count(distinct so) as options, min(so) as option from r group by group_id)
select group_id, 'group-type-conflict' as kind from g where types <> 1 or type not in ('A3', 'B1')
union all select group_id, 'group-scope-conflict' from g where years <> 1 or units <> 1
union all select group_id, 'shared-stem-conflict' from g where type = 'A3' and (stems <> 1 or stem = '')
union all select group_id, 'shared-options-conflict' from g where type = 'B1' and (options <> 1 or option = '')""")
def group_consistency(q):
    return sequence.group_conflicts(q)


@_on("questions", sql="""
with q as (select id, regexp_extract(id, '^(\\d{4})(-|$)', 1) as year, unit, number from questions)
select a.id, exists (select 1 from q b where b.year = a.year and b.unit = a.unit and b.number = a.number + 1) as next_exists from q a""")
def next_number_present(q):
    return sequence.next_number(q)


_GRAMS = lambda c: f"case when length({c}) > 1 then list_distinct(list_transform(generate_series(1, length({c}) - 1), lambda i: substr({c}, i, 2))) else [] end"


@_on("questions", sql=rf"""
with l as (select id, subject_id, number, group_id, string_split(regexp_replace({_nfkc(_lines(_trim("stem || coalesce(options[answer], '')"), _trim("explanation")))}, '{_LOOSE}', '', 'g'), chr(30)) as t from questions where subject_id is not null),
q as (select id, subject_id, group_id, {_GRAMS("t[1]")} as e, {_GRAMS("t[2]")} as a, row_number() over (order by subject_id, number, id) as pos from l),
n as (select id, group_id, e, a, pos, case when lag(subject_id) over w = subject_id then lag(e) over w else [] end as before, case when lead(subject_id) over w = subject_id then lead(e) over w else [] end as after,
  count(*) over () as total from q window w as (order by pos)),
s as (select id, case when len(e) > 0 then len(list_intersect(e, a)) / len(e) else 0.0 end as own, greatest(case when len(before) > 0 then len(list_intersect(before, a)) / len(before) else 0.0 end,
  case when len(after) > 0 then len(list_intersect(after, a)) / len(after) else 0.0 end) as neighbours from n where pos > 1 and pos < total and coalesce(group_id, '') = '')
select id, round(own, 9) as own, round(neighbours, 9) as neighbours, own < 0.08 and neighbours > own + 0.12 as suspect from s""")
def neighbour_overlap(q):
    """The items with a subject in the order of subject, number and id."""
    rows = q.filter("subject_id is not null").withColumn("expected", F.concat("stem", F.coalesce(F.try_element_at("options", "answer"), F.lit(""))))
    out = sequence.neighbour_overlap(rows, ["number", "id"], "expected", "explanation", "subject_id")
    return out.select("id", F.round("own", 9).alias("own"), F.round("neighbours", 9).alias("neighbours"), "suspect")


# ---- papers


@_on("questions", sql=f"""
select id, unit, type, draw_pos from (select id, unit, type, row_number() over (partition by unit, type order by md5('{SEED}|' || id), id) as draw_pos from questions)
where draw_pos <= 5""")
def stratified_quota(q):
    """Five random items of every stratum: the quota is the feature."""
    strata = q.select("unit", "type").distinct().withColumn("count", F.lit(5))
    return paper.stratified_quota(q, strata, ["unit", "type"], SEED).select("id", "unit", "type", F.col("draw_pos").cast("long").alias("draw_pos"))


def _plan(q: DataFrame) -> DataFrame:
    """The blueprint, its counts cut to what the tables can fill: at most a third of a stratum's items, an even number, 2 at least."""
    pool = q.groupBy("unit", "type").agg(F.count("*").alias("pool"))
    rows = schema.blueprint(q.sparkSession).join(pool, ["unit", "type"])
    most = F.greatest(F.lit(2), 2 * F.floor(F.col("pool") / 6)).cast("int")
    return rows.select("unit", "section_ord", "type", F.least("count", most).alias("count"))


@_on("questions")
def exam_paper(q):
    """One paper for each unit: exact section totals of whole groups."""
    return paper.exam_paper(_ordered(q), _plan(q), SEED).select("unit", "paper_pos", "id", "type", "section_ord")


@_on("questions")
def exam_paper_pages(q):
    """Papers on pages of ten at most, one type to a page, groups whole; items and blocks of each page."""
    drawn = paper.exam_paper(_ordered(q), _plan(q), SEED).select("unit", "paper_pos", "id", "type", "group_id")
    return paper.pages(drawn, ["unit"]).groupBy("unit", "page_no", "type").agg(F.count("*").alias("items"), F.count_distinct(F.coalesce("group_id", "id")).alias("blocks"))


_PLAN = f"""
plan as (select b.unit, b.type, b.section_ord, least(b.count, greatest(2, 2 * (p.pool // 6))) as wanted from (values {", ".join(map(str, schema.BLUEPRINT))}) b(unit, section_ord, type, count)
  join (select unit, type, count(*) as pool from questions group by unit, type) p on p.unit = b.unit and p.type = b.type)"""


def _paper_rules(drawn: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """(*by, items, ids, ordered, whole, known): how many rows and ids a paper has, whether types follow the order, groups are whole, and all ids are the bank's."""
    key = F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("id"))
    sizes = q.groupBy(key.alias("block")).agg(F.count("*").alias("size"))
    rows = drawn.withColumns({"block": key, "rank": paper.type_rank(F.col("type"))}).join(sizes, "block")
    blocks = rows.groupBy(*by, "block").agg(F.count("*").alias("n"), F.max("size").alias("size")).groupBy(*by).agg(F.bool_and(F.col("n") == F.col("size")).alias("whole"))
    w = W.partitionBy(*by).orderBy("paper_pos")
    seen = rows.withColumn("before", F.lag("rank").over(w)).join(q.select("id", F.lit(True).alias("known")), "id", "left")
    told = seen.groupBy(*by).agg(F.count("*").alias("items"), F.count_distinct("id").alias("ids"), F.bool_and(F.coalesce(F.col("before") <= F.col("rank"), F.lit(True))).alias("ordered"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))
    return told.join(blocks, by).select(*by, "items", "ids", "ordered", "whole", "known")


@_on("questions", sql=f"with {_PLAN} select unit, cast(sum(wanted) as bigint) as items, cast(sum(wanted) as bigint) as ids, true as ordered, true as whole, true as known from plan group by unit")
def exam_paper_rules(q):
    """What every exam paper has to fulfil: the blueprint's total, no item twice, sections in order, groups whole."""
    return _paper_rules(paper.exam_paper(_ordered(q), _plan(q), SEED).select("unit", "paper_pos", "id", "type", "group_id"), q, ["unit"])


@_on("questions", sql=f"with {_PLAN} select unit, cast(sum(wanted) as bigint) as items, true as small, true as typed, true as whole, true as full from plan group by unit")
def exam_page_rules(q):
    """What the pages of every exam have to fulfil: ten items at most, one type, groups on one page, and no page that the next block would have fitted on."""
    drawn = paper.exam_paper(_ordered(q), _plan(q), SEED).select("unit", "paper_pos", "id", "type", "group_id")
    rows = paper.pages(drawn, ["unit"]).withColumn("block", F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("id")))
    groups = rows.groupBy("unit", "block").agg(F.count_distinct("page_no").alias("n")).groupBy("unit").agg((F.max("n") == 1).alias("whole"))
    pages = rows.groupBy("unit", "page_no").agg(F.count("*").alias("n"), F.count_distinct("type").alias("types"), F.min("type").alias("type"), F.min_by("block", "paper_pos").alias("first"))
    sizes = rows.groupBy("unit", "block").agg(F.count("*").alias("size"))
    w = W.partitionBy("unit").orderBy("page_no")
    beside = pages.join(sizes.withColumnRenamed("block", "first"), ["unit", "first"]).withColumns({"n0": F.lag("n").over(w), "t0": F.lag("type").over(w)})
    told = beside.groupBy("unit").agg(
        F.sum("n").alias("items"), (F.max("n") <= schema.PAGE_SIZE).alias("small"), (F.max("types") == 1).alias("typed"),
        F.bool_and(F.coalesce((F.col("t0") != F.col("type")) | (F.col("n0") + F.col("size") > schema.PAGE_SIZE), F.lit(True))).alias("full"),
    )
    return told.join(groups, "unit").select("unit", "items", "small", "typed", "whole", "full")


@_on("questions", sql="select 60 as asked, 60::bigint as items, 60::bigint as ids, true as ordered, true as whole, true as known union all select count(*)::integer + 5, count(*), count(*), true, true, true from questions")
def review_paper_rules(q):
    """A review of 60 items, and one of more than there are, which is the whole bank."""
    n = q.count()
    out = [_paper_rules(paper.review_paper(_ordered(q), k, SEED).withColumn("asked", F.lit(k)), q, ["asked"]) for k in (60, n + 5)]
    return out[0].unionByName(out[1])


@_on("questions", sql="select 40::bigint as most, true as ids, true as ordered, true as whole, true as known, true as own")
def subject_review_rules(q):
    """A review of at most 40 items of one subject: whole groups, no item twice, none of another subject."""
    first = q.agg(F.min("subject_id")).first()[0]
    own = q.filter(F.col("subject_id") == first)
    drawn = paper.review_paper(_ordered(own), 40, SEED, at_most=True)
    told = _paper_rules(drawn.withColumn("asked", F.lit(40).cast("long")), own, ["asked"])
    return told.select(F.greatest("asked", "items").alias("most"), (F.col("ids") == F.col("items")).alias("ids"), "ordered", "whole", "known", F.lit(drawn.filter(F.col("subject_id") != first).isEmpty()).alias("own"))


@_on("questions", sql="select true as differ, true as same")
def seeds_of_papers(q):
    """Two seeds give other papers, one seed gives the same."""
    one, two, again = (paper.review_paper(_ordered(q), 60, seed).select("id", "paper_pos") for seed in (SEED, SEED + 1, SEED))
    return q.sparkSession.createDataFrame([(not one.exceptAll(two).isEmpty(), one.exceptAll(again).isEmpty())], "differ boolean, same boolean")


@_on("questions", sql=f"with {_PLAN} select unit, type, cast(wanted as integer) as count, cast(wanted as bigint) as reached from plan")
def whole_block_exact_total(q):
    """The reached totals of each section beside the wanted ones."""
    drawn = paper.exam_paper(_ordered(q), _plan(q), SEED).groupBy("unit", "type").agg(F.count("*").alias("reached"))
    return drawn.join(_plan(q), ["unit", "type"]).select("unit", "type", "count", "reached")


@_on("questions")
def review_paper(q):
    return paper.review_paper(_ordered(q), 60, SEED).select("paper_pos", "id", "type", "group_id")


@_on("questions")
def subject_review_paper(q):
    """A review of at most 40 items for the subject with the smallest id."""
    first = q.agg(F.min("subject_id")).first()[0]
    return paper.review_paper(_ordered(q).filter(F.col("subject_id") == first), 40, SEED, at_most=True).select("paper_pos", "id", "type", "group_id")


@_on("mistake_book", "questions", sql=f"""
with r as (select q.id, number, case when type in ('A3', 'B1') and coalesce(group_id, '') <> '' then type || ':' || group_id else 'question:' || q.id end as block
  from questions q where q.id in (select question_id from mistake_book))
select id, row_number() over (order by md5('{SEED}|' || block), block, coalesce(number, 0), id) as pos from r""")
def mistake_book_order(book, q):
    return paper.mistake_order(book.select(F.col("question_id").alias("id")), q, SEED)


# ---- quality


_SCAN = {
    "watermark-or-source-noise": quality.SCAN_RULES[0][2], "header-footer-or-ocr-tool-noise": quality.SCAN_RULES[1][2],
    "embedded-latin-letter-confusion": quality.SCAN_RULES[6][2],
} | {n: p for n, _, p in quality.SCAN_RULES}
_RE2 = lambda p: p.replace("'", "''").replace(r"\s", r"[ \t\n\x0B\f\r]")
_TRIM = r"regexp_replace(regexp_replace(text, '^[\s\x0B\x{85}\p{Z}\x{FEFF}]+', ''), '[\s\x0B\x{85}\p{Z}\x{FEFF}]+$', '')"
_TESTS = " union all ".join(f"select id, field, field_group, '{n}' as issue_type from t where regexp_matches(text, '{_RE2(p)}')" for n, p in _SCAN.items())
_SCANNED = f"""
with t as (select * from (select id, field, field_group, {_TRIM} as text from ({_CELLS})) where text <> ''), found as ({_TESTS}
  union all select id, field, field_group, 'embedded-question-type-label' from t where regexp_matches(text, '{_RE2(quality.TYPE_LABEL[0])}')
    or regexp_matches(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'), '{quality.TYPE_LABEL[1]}'))"""


@_on("questions", sql=_SCANNED + " select distinct id, field, field_group, issue_type from found")
def quality_scan(q):
    """Candidates of the rules that are literal patterns; brackets and numbering have queries of their own."""
    rows = quality.scan_candidates(q).filter(~F.col("issue_type").isin("unbalanced-brackets", "possible-next-question-number"))
    return rows.select("id", "field", "field_group", "issue_type")


@_on("questions", sql=_SCANNED + " select issue_type, count(*) as issues, count(distinct id) as ids from (select distinct id, field, issue_type from found) group by issue_type")
def quality_issue_counts(q):
    rows = quality.scan_candidates(q).filter(~F.col("issue_type").isin("unbalanced-brackets", "possible-next-question-number"))
    return quality.issue_counts(rows, "issue_type")


@_on("questions", sql=_SCANNED + " select field_group, issue_type, count(*) as issues, count(distinct id) as ids from (select distinct id, field, field_group, issue_type from found) group by all")
def scan_report(q):
    """Candidates by kind of field and issue, for the rules that are literal patterns."""
    rows = quality.scan_candidates(q).filter(~F.col("issue_type").isin("unbalanced-brackets", "possible-next-question-number"))
    return quality.issue_counts(rows, "field_group", "issue_type")


@_on("questions", sql=f"""
with t as (select id, field, text from ({_CELLS}) where regexp_matches(text, '[（()）【】〖〗\\[\\]]')),
c as (select id, field, unnest(string_split(text, '')) as c, unnest(generate_series(1, length(text))) as i from t),
d as (select id, field, i, {", ".join(f"sum(case c when '{a}' then 1 when '{b}' then -1 else 0 end) over w as d{n}" for n, (a, b) in enumerate(X.BRACKETS))} from c
  window w as (partition by id, field order by i))
select id, field from d group by id, field having {" or ".join(f"min(d{n}) < 0 or arg_max(d{n}, i) <> 0" for n in range(5))}""")
def unbalanced_brackets(q):
    return quality.scan_candidates(q).filter("issue_type = 'unbalanced-brackets'").select("id", "field")


@_on("questions", sql=rf"""
with n as (select id, 1 + case when try_cast(regexp_extract(id, '^(\d{{4}})(-|$)', 1) as integer) between 2019 and 2022 and unit is not null then (unit - 1) * 150 + number else number end as next from questions)
select distinct t.id, t.field from (select id, field, {_trim("text")} as text from ({_CELLS})) t join n using (id)
where next is not null and regexp_matches(text, '(?i)(^|[。；;，,\s\x0B])' || next || '[IL]?[.．、](\s|\x0B|$|[【〖\x{{3400}}-\x{{9FFF}}])')""")
def next_number_in_text(q):
    return quality.scan_candidates(q).filter("issue_type = 'possible-next-question-number'").select("id", "field")


@_on("questions", sql=f"""
with e as (select id, {_TRIM.replace("text", "coalesce(explanation, '')")} as e from questions)
select id, case when e = '' then 'missing-explanation-empty' when regexp_matches(e, '{quality.MISSING_EXPLANATION}') then 'missing-explanation-placeholder'
  else 'missing-explanation-unusable' end as issue_type from e where e = '' or regexp_matches(e, '{quality.MISSING_EXPLANATION}') or regexp_matches(e, '{quality.UNUSABLE_EXPLANATION}')""")
def missing_explanations(q):
    return quality.missing_explanations(q)


@_on("questions", sql=f"""
select distinct id, field from ({_CELLS}) where field in ('stem', 'explanation', 'prompt', 'shared_stem') and regexp_matches(text, '{_RE2(quality.HIGH_RISK)}')""")
def high_risk_wording(q):
    return quality.high_risk_wording(q)


@_on("questions", sql="""
with c as (select id, 'stem' as problem, trim(coalesce(stem, '')) = '' as bad from questions union all select id, 'explanation', trim(coalesce(explanation, '')) = '' from questions
  union all select id, 'answer', not coalesce(answer in ('A', 'B', 'C', 'D', 'E'), false) from questions
  union all select id, 'option-' || k, trim(coalesce(options[k], '')) = '' from questions, (select unnest(['A', 'B', 'C', 'D', 'E']) as k))
select id, problem from c where bad""")
def incomplete_items(q):
    return validate.incomplete_items(q)


@_on("questions", sql="""
with e as (select unit, type, case when unit = 0 then 0 else cast(round(avg(n)) as bigint) end as expected from (select unit, type, source, count(*) as n from questions group by all) group by unit, type),
a as (select unit, type, count(*) as actual from questions group by unit, type)
select unit, type, expected, actual from e join a using (unit, type) where expected <> actual""")
def count_validation(q):
    """Each stratum against an expectation, here the rounded mean of its sources."""
    per = q.groupBy("unit", "type", "source").agg(F.count("*").alias("n")).groupBy("unit", "type").agg(F.round(F.avg("n")).cast("long").alias("mean"))
    expected = per.select("unit", "type", F.when(F.col("unit") == 0, 0).otherwise(F.col("mean")).cast("long").alias("expected"))
    return validate.expected_counts(q, expected, ["unit", "type"])


@_on("questions", "subjects", sql="""
with n as (select subject_id, count(*) as actual from questions where subject_id is not null group by 1),
r as (select coalesce(s.subject_id, n.subject_id) as subject_id, s.subject_id is not null as listed, coalesce(actual, 0) as n, s.ord * 100 as wanted, subject_name,
  regexp_replace(source_file_name, '\\.[^.]*$', '') as bare from subjects s full join n on n.subject_id = s.subject_id)
select subject_id, 'unknown' as problem from r where not listed union all select subject_id, 'count' from r where listed and n <> wanted
union all select subject_id, 'empty' from r where listed and n = 0
union all select subject_id, 'file-name' from r where listed and (regexp_matches(subject_name, '(?i)\\.txt$|[\\\\/]') or subject_name = bare)""")
def subject_reconciliation(q, s):
    """The subject list against the bank, with an announced count of 100 times the subject's order."""
    return validate.subject_reconciliation(q, s.withColumn("count", F.col("ord") * 100))


_SHARED = [f"shared_options['{k}']" for k in schema.LETTERS]


def _audit_sql() -> str:
    """The structural audit in SQL: one query for each kind of issue, numbers of neighbouring questions as patterns of each row."""
    pattern = lambda p: p.replace("'", "''")
    some = lambda c: f"{_trim(c)} = ''"
    letters = "['A', 'B', 'C', 'D', 'E']"
    issue = lambda test, kind, field, severity="'error'": f"select id, {severity} as severity, '{kind}' as kind, '{field}' as field from r where {test}"
    by_history = "case when strict then 'error' else 'warning' end"
    grouped = "kind_ in ('A3', 'B1')"
    missing, odd = f"regexp_matches(e, '{pattern(quality.AUDIT_PLACEHOLDER)}')", f"regexp_matches(e, '{pattern(quality.AUDIT_UNUSABLE)}')"
    keys = lambda c: f"coalesce(list_sort(map_keys({c})), [])"
    records = [
        issue(some("id"), "missing-id", "id"), issue(some("stem"), "missing-stem", "stem"), issue(f"{keys('options')} <> {letters}", "invalid-option-keys", "options"),
        *(issue(some(c), "missing-option", f"option-{k}") for k, c in zip(schema.LETTERS, _OPTIONS)),
        issue(f"not coalesce({_trim('answer')} in ('A', 'B', 'C', 'D', 'E') and {_trim('options[' + _trim('answer') + ']')} <> '', false)", "invalid-answer", "answer"),
        issue("e = ''", "empty-explanation", "explanation"), issue("kind_ not in ('A1/A2', 'A3', 'B1')", "invalid-type", "type"),
        issue(f"{grouped} and {some('group_id')}", "missing-group-id", "group_id"), issue(f"{grouped} and {some('prompt')}", "missing-group-prompt", "prompt"),
        issue(f"kind_ = 'A3' and {some('shared_stem')}", "missing-shared-stem", "shared_stem"),
        issue(f"kind_ = 'B1' and ({keys('shared_options')} <> {letters} or " + " or ".join(some(c) for c in _SHARED) + ")", "invalid-shared-options", "shared_options"),
        issue(f"not {grouped} and {_trim('group_id')} <> ''", "unexpected-group-id", "group_id"),
        *(issue(f"regexp_matches({_trim(c)}, '{quality.ANSWER_MARKER}')", "embedded-answer-marker", n) for n, c in [("stem", "stem"), *((f"option-{k}", c) for k, c in zip(schema.LETTERS, _OPTIONS))]),
        issue(missing, "placeholder-explanation", "explanation", by_history), issue(f"{odd} and not {missing}", "unusable-explanation", "explanation", "'warning'"),
    ]
    found = lambda test, kind, severity=by_history: f"select id, {severity} as severity, '{kind}' as kind, field from cells where {test}"
    either = lambda numbers: f"'(' || array_to_string({numbers}, '|') || ')'"
    begins = "(([【〖]\\s*)?(解析|一\\s*点\\s*笔\\s*记)|患者|患儿|下列|上述|治疗|诊断|某|女性|男性)"
    texts = [found(f"regexp_matches(raw, '{pattern(p)}')", kind) for kind, p in quality.AUDIT_RULES]
    texts += [
        found(f"strict and regexp_matches(raw, '{quality.HISTORY_OCR}')", "history-source-ocr", "'error'"),
        found(f"len(anchors) > 0 and regexp_matches(raw, '[·•]\\s*' || {either('anchors')} || '(\\s*[（(]|$)|(^|[^\\d])' || {either('anchors')} || '[.．、]\\s*{begins}')", "merged-question-anchor"),
        found(f"len(nexts) > 0 and regexp_matches(raw, '(?i)(^|[·。；;，,\\s])' || {either('nexts')} || '[IL]?[.．、]?\\s*$')", "trailing-next-question-anchor"),
    ]
    signature = rf"lower(regexp_replace({_nfkc(' || '.join(_trim(c) for c in ('stem', *_OPTIONS)))}, '[^0-9A-Za-z\x{{3400}}-\x{{9FFF}}]', '', 'g'))"
    cells = " union all ".join(f"select id, '{n}' as field, {_trim(c)} as raw from questions" for n, c in [("stem", "stem"), ("explanation", "explanation"), *((f"option-{k}", c) for k, c in zip(schema.LETTERS, _OPTIONS))])
    return rf"""
with y as (select *, try_cast(regexp_extract(id, '^(\d{{4}})(-|$)', 1) as integer) as year, epoch_us(imported_at) as t from questions),
r as (select *, coalesce(year between 2018 and 2022, false) as strict, {_trim("explanation")} as e, coalesce(nullif({_trim("type")}, ''), '(missing)') as kind_,
  exists (select 1 from y b where b.year is not distinct from y.year and b.year is not null and b.unit = y.unit and b.number = y.number + 1) as has_next from y),
a as (select *, case when strict then case when year = 2018 then number else (unit - 1) * 150 + number end end as current, case when has_next then number + 1 end as local from r),
f as (select *, case when strict then case when year = 2021 then case when unit between 1 and 4 then case when number < case when unit = 4 then 126 else 150 end then number + 1 when unit < 4 then 1 end end
  when current < case when year = 2018 then 162 else 600 end then current + 1 end end as following from a),
n as (select id, strict, list_distinct(list_filter([number, local, current, following], lambda x: x is not null)) as anchors, list_distinct(list_filter([local, following], lambda x: x is not null)) as nexts from f),
cells as (select c.*, n.strict, n.anchors, n.nexts from ({cells}) c join n using (id) where raw <> ''),
s as (select id, t, {signature} as key, {_trim("id")} as i from r),
repeated as (select id, 'duplicate-id' as kind, 'id' as field, row_number() over (partition by i order by t, id) as k from s where i <> ''
  union all select id, 'duplicate-question-content', null, row_number() over (partition by key order by t, id) from s where key <> ''),
g as (select group_id, count(distinct type) as types, arg_min(type, struct_pack(n := number, i := id)) as type, count(distinct coalesce(year, -1)) as years, count(distinct coalesce(unit, -1)) as units,
  count(distinct coalesce(trim(shared_stem), '')) as stems, min(coalesce(trim(shared_stem), '')) as stem, count(distinct {_SHARED_ROW}) as options, min({_SHARED_ROW}) as option,
  count(distinct group_start) = 1 and count(distinct group_end) = 1 and count(group_start) = count(*) and count(group_end) = count(*) as agreed,
  list_sort(list(number)) as numbers, min(group_start) as low, max(group_end) as high from y where coalesce(group_id, '') <> '' group by group_id)
{" union all ".join(records)} union all {" union all ".join(texts)}
union all select id, 'error', kind, field from repeated where k > 1
union all select group_id, 'error', 'group-type-conflict', 'group_id' from g where types <> 1 or type not in ('A3', 'B1')
union all select group_id, 'error', 'group-scope-conflict', 'group_id' from g where years <> 1 or units <> 1
union all select group_id, 'error', 'shared-stem-conflict', 'shared_stem' from g where type = 'A3' and (stems <> 1 or stem = '')
union all select group_id, 'error', 'shared-options-conflict', 'shared_options' from g where type = 'B1' and (options <> 1 or option = '')
union all select group_id, 'error', case when agreed then 'incomplete-group-members' else 'group-range-conflict' end, 'group_start/group_end' from g
  where not agreed or low > high or numbers <> generate_series(low, high)"""


_SHARED_ROW = "case when shared_options is null then '' else array_to_string([" + ", ".join(f"'{k}:' || coalesce(trim({c}), '')" for k, c in zip(schema.LETTERS, _SHARED)) + "], '|') end"


@_on("questions", sql=_audit_sql())
def structural_audit(q):
    return quality.structural_issues(_ordered(q)).select("id", "severity", "kind", "field")


@_on("questions", sql=f"select severity, kind, count(*) as issues, count(distinct id) as ids from ({_audit_sql()}) group by severity, kind")
def structural_audit_counts(q):
    return quality.issue_counts(quality.structural_issues(_ordered(q)), "severity", "kind")


@_on("questions", sql="""
with m as (select id, answer, unnest(regexp_extract_all(explanation, '(?i)(?:正确答案|答案|故|本题)(?:应|当|为|是|选|选择|选用|应该选择)*[：:，,。；; ]*([A-E])(?:[^A-Za-z]|$)', 1)) as stated from questions)
select distinct id, upper(stated) as stated from m where upper(stated) is distinct from answer""")
def stated_answer_conflicts(q):
    return quality.stated_answer_conflicts(q)


@_on("questions", sql=f"select id from questions where regexp_matches({_TRIM.replace('text', 'stem')}, '{quality.PLACEHOLDER_STEM}')")
def placeholder_stems(q):
    return quality.placeholder_stems(q)




@_on("questions", sql=rf"""
with f as (select group_id, type, number, id, {_trim("prompt")} as p, string_split(regexp_replace({_nfkc(_lines(*(_trim(c) for c in (*_OPTIONS, *_SHARED))))}, '{_LOOSE}', '', 'g'), chr(30)) as t from questions where group_id <> ''),
g as (select group_id, count(*) as n, bool_or(p = '') as blank, bool_or(regexp_matches(p, '{quality.PLACEHOLDER_STEM}')) as label, arg_min(type, struct_pack(n := number, i := id)) as type,
  count(distinct array_to_string(t[1:5], '|')) as owns, bool_or(t[1:5] <> t[6:10]) as differs from f group by group_id)
select group_id, 'single' as kind from g where n < 2 union all select group_id, 'blank-prompt' from g where (type = 'B1' and (blank or label)) or (type = 'A3' and blank)
union all select group_id, 'options' from g where type = 'B1' and (owns <> 1 or differs)""")
def group_member_issues(q):
    return quality.group_member_issues(q)


@_on("questions", sql=rf"""
with {_LOOSED}, r as (select id, t[1] as said, t[3:7] as o, case when answer in ('A', 'B', 'C', 'D', 'E') then ascii(answer) - 64 end as k from loosed)
select id from r where length(o[k]) >= 2 and not contains(said, o[k])
  and len(list_filter(generate_series(1, 5), lambda i: i <> k and length(o[i]) >= 2 and contains(said, o[i]))) > 0""")
def answer_not_explained(q):
    return quality.answer_not_explained(q)


@_on("questions", sql=f"""
with {_LOOSED} select min(id) as first_id, count(*) as members, count(distinct coalesce(nullif(group_id, ''), id)) as groups from loosed
group by t[1] having count(*) > 1 and count(distinct coalesce(nullif(group_id, ''), id)) > 1""")
def repeated_explanations(q):
    return quality.repeated_explanations(q)


@_on("questions", sql=" union all ".join(
    f"select '{n}' as kind, count(*) as found from ({SQL[n]})" for n in ("placeholder_stems", "stated_answer_conflicts", "duplicate_answer_conflicts", "answer_not_explained", "repeated_explanations", "group_member_issues")
) + f" union all select 'neighbour_overlap', count(*) from ({SQL['neighbour_overlap']}) where suspect")
def subject_quality_report(q):
    """How much each rule of the subject audit finds."""
    parts = {
        "placeholder_stems": placeholder_stems(q), "stated_answer_conflicts": stated_answer_conflicts(q), "duplicate_answer_conflicts": duplicate_answer_conflicts(q), "answer_not_explained": answer_not_explained(q),
        "repeated_explanations": repeated_explanations(q), "group_member_issues": group_member_issues(q), "neighbour_overlap": neighbour_overlap(q).filter("suspect"),
    }
    rows = [df.agg(F.count("*").alias("found")).select(F.lit(n).alias("kind"), "found") for n, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@_on("questions", sql=f"""
with r as (select group_id, nullif(nullif({_TRIM.replace("text", "coalesce(explanation, '')")}, ''), '原文件未提供解析。') as given from questions where type = 'B1' and group_id <> '')
select group_id, case when count(given) = 0 then 'none' when count(given) < count(*) then 'merged' when count(distinct given) = 1 then 'shared' else 'individual' end as policy,
  count(distinct given) as texts from r group by group_id""")
def explanation_policy(q):
    return quality.explanation_policy(q)


# ---- the answer log


_CLEAN = """
clean as (select session_id, seq, ts, received_at, mode, question_id, action, upper(letter) as letter from (
  select *, row_number() over (partition by session_id, seq order by received_at, ts, question_id, coalesce(upper(letter), '')) as n from answer_log) where n = 1)"""


@_on("answer_log", sql=f"with {_CLEAN} select session_id, seq, ts, received_at, mode, question_id, action, letter from clean")
def clean_events(log):
    return events.clean_events(log).select("session_id", "seq", "ts", "received_at", "mode", "question_id", "action", "letter")


_FEEDBACK = """
fb as (select c.*, q.answer, coalesce(letter = answer, false) as hit, coalesce(max(case when coalesce(letter = answer, false) then 1 else 0 end)
    over (partition by session_id, question_id order by ts, seq rows between unbounded preceding and 1 preceding), 0) as done
  from clean c join questions q on q.id = c.question_id where mode = 'review' and action = 'answer')"""


@_on("answer_log", "questions", sql=f"""
with {_CLEAN}, {_FEEDBACK} select session_id, question_id, count(*) as attempts, arg_min(hit, struct_pack(ts := ts, seq := seq)) as first_correct, bool_or(hit) as resolved,
  last(letter order by ts, seq) as last_letter from fb where done = 0 group by session_id, question_id""")
def first_attempt_fold(log, q):
    clean = events.clean_events(log)
    return events.feedback_fold(clean, q).select("session_id", "question_id", "attempts", "first_correct", "resolved", "last_letter")


@_on("answer_log", "questions", sql=f"""
with {_CLEAN}, {_FEEDBACK} select distinct session_id, question_id, letter, hit as "right" from fb where done = 0 and letter is not null""")
def option_results(log, q):
    return events.option_results(events.clean_events(log), q)


_EXAM = """
sub as (select session_id, min(struct_pack(ts := ts, seq := seq)) as at from clean where mode = 'exam' and action = 'submit' group by session_id),
ans as (select c.session_id, c.question_id, sub.at.ts as submitted_at, last(letter order by c.ts, c.seq) as letter from clean c join sub using (session_id)
  where mode = 'exam' and action = 'answer' and struct_pack(ts := c.ts, seq := c.seq) < sub.at group by all)"""


@_on("answer_log", sql=f"with {_CLEAN}, {_EXAM} select session_id, question_id, submitted_at, letter from ans")
def last_answer_before_submit(log):
    return events.exam_answers(events.clean_events(log))


@_on("answer_log", "questions", sql=f"""
with {_CLEAN}, {_EXAM}, papers as (select distinct session_id, question_id from clean where mode = 'exam' and action = 'answer' and session_id in (select session_id from sub)),
g as (select p.session_id, p.question_id, coalesce(a.letter = q.answer, false) as hit, a.letter is null as blank from papers p left join ans a using (session_id, question_id) left join questions q on q.id = p.question_id)
select session_id, count(*) as total, count(*) filter (where hit) as correct, count(*) filter (where not hit) as wrong, count(*) filter (where blank) as unanswered,
  coalesce(string_agg(question_id, ',' order by question_id) filter (where not hit), '') as wrong_ids from g group by session_id""")
def grade_submission(log, q):
    """Papers are all questions an exam session ever answered; answers after the submission leave them blank."""
    clean = events.clean_events(log)
    exam = clean.filter("mode = 'exam'")
    submitted = exam.filter("action = 'submit'").select("session_id").distinct()
    papers = exam.filter("action = 'answer'").select("session_id", "question_id").distinct().join(submitted, "session_id", "left_semi")
    return events.grade_totals(events.grade(papers, events.exam_answers(clean), q)).withColumn("wrong_ids", F.array_join("wrong_ids", ","))


@_on("answer_log", "questions", sql=f"""
with {_CLEAN}, {_FEEDBACK}, {_EXAM},
ev as (select question_id, ts, session_id, seq, 'wrong' as kind, 'review' as source, false as unanswered from fb where done = 0 and not hit
  union all select a.question_id, sub.at.ts, a.session_id, sub.at.seq, 'wrong', 'exam', a.letter is null from ans a join sub using (session_id) left join questions q on q.id = a.question_id where not coalesce(a.letter = q.answer, false)
  union all select c.question_id, ts, session_id, seq, 'mark', null, false from clean c join questions q on q.id = c.question_id where mode = 'wrong-book' and action = 'answer' and letter = answer
  union all select question_id, ts, session_id, seq, 'remove', null, false from clean where action = 'remove' and question_id is not null),
o as (select *, struct_pack(ts := ts, s := session_id, seq := seq) as moment from ev),
cut as (select question_id, max(moment) as cut from o where kind = 'remove' group by question_id),
live as (select o.* from o left join cut using (question_id) where kind <> 'remove' and (cut is null or moment > cut)),
w as (select question_id, min(moment) as first, count(*) as wrong_count, bool_or(source = 'review') as review, bool_or(source = 'exam') as exam, arg_max(source, moment) as last_source,
  arg_max(unanswered, moment) as last_unanswered, max(ts) as last_wrong from live where kind = 'wrong' group by question_id),
m as (select l.question_id, max(l.ts) as correct_at from live l join w on w.question_id = l.question_id where kind = 'mark' and moment > first group by l.question_id)
select w.question_id, review, exam, wrong_count, last_source, last_unanswered, correct_at is not null as correct_in_book, correct_at, w.first.ts as created_at,
  greatest(last_wrong, correct_at) as updated_at from w left join m using (question_id)""")
def mistake_book_fold(log, q):
    return events.mistake_fold(written(events.mistake_events(events.clean_events(log), q), "mistakes"))


@_on("answer_log", "questions", sql=f"""
with {_CLEAN}, {_EXAM}, g as (select a.session_id, a.question_id, dense_rank() over (partition by a.session_id order by a.question_id) as pos, coalesce(a.letter = q.answer, false) as hit,
  case when q.type in ('A3', 'B1') and coalesce(q.group_id, '') <> '' then q.group_id else q.id end as block from ans a join questions q on q.id = a.question_id)
select session_id, block, min(pos) as first_wrong, array_to_string(list(question_id order by pos), ',') as wrong_ids from g where not hit group by session_id, block""")
def exam_result_groups(log, q):
    """Blocks with wrong members of each graded exam; the paper's order is that of the ids."""
    answers = events.exam_answers(events.clean_events(log))
    graded = events.grade(answers.select("session_id", "question_id"), answers, q).join(q.select(F.col("id").alias("question_id")), "question_id", "left_semi")
    ordered = graded.groupBy("session_id").agg(F.array_sort(F.collect_set("question_id")).alias("ids"))
    placed = ordered.select("session_id", F.posexplode("ids").alias("pos", "question_id")).withColumn("pos", (F.col("pos") + 1).cast("long"))
    rows = lookup.result_groups(graded.join(placed, ["session_id", "question_id"]), q)
    return rows.select("session_id", "block", "first_wrong", F.array_join("wrong_ids", ",").alias("wrong_ids"))


@_on("questions", sql="""
select id, case when year between 2019 and 2022 and unit is not null then (unit - 1) * 150 + number else number end as source_number
from (select id, unit, number, try_cast(regexp_extract(id, '^(\\d{4})(-|$)', 1) as integer) as year from questions)""")
def source_numbers(q):
    return q.select("id", X.source_number(F.col("id"), F.col("unit"), F.col("number")).alias("source_number"))


@_on("questions", sql="""
select id, case when options is null then '' else 'A:' || trim(coalesce(options['A'], '')) || '|B:' || trim(coalesce(options['B'], '')) || '|C:' || trim(coalesce(options['C'], ''))
  || '|D:' || trim(coalesce(options['D'], '')) || '|E:' || trim(coalesce(options['E'], '')) end as signature from questions""")
def option_signatures(q):
    return q.select("id", lookup.option_signature(F.col("options")).alias("signature"))


@_on("questions")
def distributed_explanations(q):
    return scanned_bank.distributed_explanations(q)


@_on("questions", sql="""
select id from questions where trim(coalesce(explanation, '')) not in ('', '原文件未提供解析。')""")
def explained_items(q):
    return lookup.explained(q, "原文件未提供解析。").select("id")


@_on("mistake_book", "questions", sql="select question_id as id from mistake_book where question_id in (select id from questions) and wrong_count >= 2")
def pruned_session(book, q):
    """A mistake session of all entries with two errors or more, after pruning to what the bank still has."""
    session = book.filter("wrong_count >= 2").select(F.col("question_id").alias("id"), F.lit(0).alias("pos"))
    return lookup.pruned_ids(session, book, q).select("id")


@_on("mistake_book", sql="""
select question_id, coalesce(sources.review, false) as review, coalesce(sources.exam, false) as exam, greatest(1, coalesce(wrong_count, 1)) as wrong_count, last_source,
  coalesce(last_unanswered, false) as last_unanswered, coalesce(correct_in_book, false) as correct_in_book, case when correct_in_book then correct_at end as correct_at, created_at, updated_at
from mistake_book where question_id is not null""")
def normalised_book(book):
    return events.normalise_book(book)


@_on("mistake_book", sql="select question_id, not coalesce(correct_in_book, false) as confirm from mistake_book where question_id is not null")
def removal_confirmation(book):
    return events.needs_confirmation(book)


@_on("answer_log", "questions", sql="""
select session_id, bool_and(question_id in (select id from questions)) as valid from answer_log where question_id is not null group by session_id""")
def valid_sessions(log, q):
    return events.valid_sessions(log, q)


@_on("answer_log", sql="""
select mode, action, date_trunc('month', ts) as month, count(*) as rows, count(distinct session_id) as sessions, count(*) filter (where received_at > ts + interval 1 day) as late
from answer_log group by all""")
def log_profile(log):
    late = F.col("received_at") > F.col("ts") + F.make_dt_interval(F.lit(1))
    return log.groupBy("mode", "action", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(
        F.count("*").alias("rows"), F.count_distinct("session_id").alias("sessions"), F.count_if(late).alias("late")
    )


# ---- fusion and alignment


@_on("answer_log", "questions", sql=f"""
with {_CLEAN}, a as (select question_id, first(letter order by ts, session_id, seq) as low, last(letter order by ts, session_id, seq) as high from clean
  where action = 'answer' and letter is not null group by question_id)
select q.id, low, high, case when low in ('A','B','C','D','E') and high in ('A','B','C','D','E') and low <> high then null
  else coalesce(case when low in ('A','B','C','D','E') then low end, case when high in ('A','B','C','D','E') then high end) end as fused
from questions q left join a on a.question_id = q.id""")
def answer_fusion(log, q):
    """The first and the last letter given to each question as two readings of its key."""
    at = F.struct("ts", "session_id", "seq")
    rows = events.clean_events(log).filter("action = 'answer' and letter is not null").groupBy(F.col("question_id").alias("id")).agg(F.min_by("letter", at).alias("low"), F.max_by("letter", at).alias("high"))
    return q.select("id").join(rows, "id", "left").select("id", "low", "high", fusion.fuse_letters(F.col("low"), F.col("high")).alias("fused"))


@_on("questions")
def sequence_alignment(q):
    """Item numbers as a careless reading has them (items without a subject lost, numbers of unexplained items unknown) against the expected numbers of each paper."""
    rows = q.withColumns({"year": X.year_of(F.col("id")), "paper": F.floor((F.col("number") - 1) / 150).cast("int")}).filter("year is not null and number is not null")
    by = ["year", "unit", "paper"]
    seen = rows.groupBy(*by, F.col("number").alias("pos")).agg(F.max(F.when(F.col("explanation").isNotNull(), F.col("number"))).alias("number"), F.max("subject_id").alias("s"))
    wanted = rows.select(*by, "number").distinct().withColumn("ord", F.col("number"))
    return fusion.align_sequences(seen.filter("s is not null").drop("s"), wanted, by)


@_on("questions", "bank_sources")
def near_match_stems(q, b):
    """Best near matches of the stems from web sources among those of documents, under the alphanumeric key."""
    rows = q.join(b.select("source", "kind"), "source").select("id", "kind", X.alnum_key(F.col("stem")).alias("text")).filter("text <> ''")
    return fusion.near_matches(rows.filter("kind = 'web'").select("id", "text"), rows.filter("kind = 'docx'").select("id", "text"))


@_on("questions", sql="select count(*) as n, count(distinct id) as ids, count(distinct type) as types from questions")
def bank_counts(q):
    return q.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("type").alias("types"))


_DIGEST = "sha256(array_to_string([" + ", ".join(f"coalesce({c}, chr(29))" for c in ("id", "stem", "answer", "explanation")) + "], chr(31)))"


@_on("questions", sql=f"""
with d as (select {_DIGEST} as d from questions), s as (select count(*) as n, {", ".join(f"sum(('0x' || substr(d, {1 + 12 * i}, 12))::bigint)::hugeint::varchar as p{i}" for i in range(5))} from d)
select n, sha256(array_to_string([n::varchar, p0, p1, p2, p3, p4], '|')) as digest from s""")
def bank_fingerprint(q):
    return files.fingerprint(q, ["id", "stem", "answer", "explanation"])


@_on("questions", "subjects", sql=f"""
with p as (select subject_id, {_DIGEST} as d, row_number() over (order by s.ord, number, id) as pos from questions join subjects s using (subject_id)),
b as (select subject_id, (pos - 1) // 65536 as b, sha256(string_agg(d, '' order by pos)) as bd from p group by all), t as (select subject_id, sha256(string_agg(bd, '' order by b)) as sd from b group by all),
n as (select ord, sha256(array_to_string([source_file_name, subject_name, coalesce(sd, '')], chr(31))) as nd from subjects left join t using (subject_id))
select substr(sha256(string_agg(nd, '' order by ord)), 1, 16) as version from n""")
def bank_version(q, s):
    """The order-sensitive version of the subjects' items."""
    return files.bank_version(q, s.withColumnRenamed("source_file_name", "source_name"), ["id", "stem", "answer", "explanation"], ["number"])


@_on("questions", sql="select id, row_number() over (order by unit, number, id) as pos from questions")
def unit_number_order(q):
    """The bank in the order of unit and number."""
    return sequence.numbered(q.select("id", "unit", "number"), "unit", "number", "id").select("id", "pos")


@_on("subjects", sql="select subject_id, row_number() over (order by subject_name collate zh) as zh, row_number() over (order by encode(subject_name)) as binary from subjects")
def subject_name_orders(s):
    """Subjects in the Chinese order of their names and in that of their code units."""
    rows = s.select("subject_id", F.collate("subject_name", "zh").alias("zh_"), "subject_name")
    one = sequence.numbered(rows, "zh_").select("subject_id", F.col("pos").alias("zh"))
    return one.join(sequence.numbered(rows, "subject_name").select("subject_id", F.col("pos").alias("binary")), "subject_id")


@_on("questions", sql="""
with n as (select regexp_extract(id, '^(\\d{4})', 1) as year, unit, count(*) as items, count(distinct number) as numbers, max(number) as last, count(*) filter (where trim(coalesce(explanation, '')) = '') as unexplained,
  count(distinct (number - 1) // 10) as pages from questions group by all) select year, unit, items, numbers, last - numbers as missing, last = numbers as complete, unexplained, pages from n""")
def paper_diagnostics(q):
    """For each year and unit: items, different numbers, numbers missing up to the last, whether none is, items without explanation, pages of ten numbers."""
    n = q.groupBy(F.regexp_extract("id", r"^(\d{4})", 1).alias("year"), "unit").agg(
        F.count("*").alias("items"), F.count_distinct("number").alias("numbers"), F.max("number").alias("last"), F.count_if(F.trim(F.coalesce("explanation", F.lit(""))) == "").alias("unexplained"),
        F.count_distinct(F.floor((F.col("number") - 1) / 10)).alias("pages"),
    )
    return n.select("year", "unit", "items", "numbers", (F.col("last") - F.col("numbers")).alias("missing"), (F.col("last") == F.col("numbers")).alias("complete"), "unexplained", "pages")


@_on("questions", "subjects", sql="""
select q.id, coalesce(s.subject_name, '') || ' ' || q.type as heading, substr(q.stem, 1, 20) as summary, q.options[q.answer] as answer_text, len(map_keys(q.options)) as choices,
  array_to_string(list_transform(list_sort(map_keys(q.options)), lambda k: k || '.' || coalesce(q.options[k], '')), ' ') as line, coalesce(q.prompt, q.stem) as asked, q.group_id is not null as grouped
from questions q left join subjects s using (subject_id)""")
def derived_texts(q, s):
    """A wide projection of texts derived from an item: heading, summary, answer text, options in one line."""
    rows = q.join(F.broadcast(s.select("subject_id", "subject_name")), "subject_id", "left")
    keys = F.array_sort(F.map_keys("options"))
    line = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("."), F.coalesce(F.try_element_at("options", k), F.lit("")))), " ")
    return rows.select(
        "id", F.concat_ws(" ", F.coalesce("subject_name", F.lit("")), "type").alias("heading"), F.substring("stem", 1, 20).alias("summary"), F.try_element_at("options", "answer").alias("answer_text"),
        F.size(F.map_keys("options")).cast("long").alias("choices"), line.alias("line"), F.coalesce("prompt", "stem").alias("asked"), F.col("group_id").isNotNull().alias("grouped"),
    )


@_on("questions", sql=f"""
with f as (select source, {_FULL} as fp, id from questions), g as (select source, min(id) as first_id, count(*) as n from f group by source, fp having count(*) > 1)
select source, count(*) as duplicates, cast(sum(n - 1) as bigint) as extra from g group by source""")
def residual_duplicates_by_source(q):
    """Repeated items by the full fingerprint within each source: how many, and how many records too many."""
    fp = F.sha2(F.concat_ws("\x1f", X.item_fingerprint(F.col("stem"), F.col("options")), F.coalesce("answer", F.lit("")), F.regexp_replace(F.coalesce("explanation", F.lit("")), r"\s+", "")), 256)
    groups = q.withColumn("fp", fp).groupBy("source", "fp").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.groupBy("source").agg(F.count("*").alias("duplicates"), F.sum(F.col("n") - 1).alias("extra"))


@_on("questions", sql=f"""
with q as (select source, source || '|' || coalesce(nullif(group_id, ''), id) as block, epoch_us(imported_at) as t, id, {_FULL} as fp from questions where source is not null),
b as (select source, block, list_sort(list(fp)) as bag, min(struct_pack(t := t, i := id)) as o from q group by source, block)
select block, first_value(block) over (partition by source, bag order by o) as kept_block from b""")
def block_dedup_by_source(q):
    """Blocks with equal bags of members within one source; the first is kept."""
    fp = F.sha2(F.concat_ws("\x1f", X.item_fingerprint(F.col("stem"), F.col("options")), F.coalesce("answer", F.lit("")), F.regexp_replace(F.coalesce("explanation", F.lit("")), r"\s+", ""), "source"), 256)
    rows = _ordered(q.filter("source is not null")).withColumns({"fp": fp, "block": F.concat_ws("|", "source", F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("id")))})
    return dedup.block_dedup(rows, "fp", "block", "bank_ord")


