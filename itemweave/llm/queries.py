"""The pN_ queries, by name, with their SQL where DuckDB can run it on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemweave.llm import contamination, format_dups, lookalike, mixing, near_dups, residue, scan_repair, site_lines, splitting, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(*tables: str):
    """Register a function of tables as the query of its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(_table(spark, sf_dir, t) for t in tables))
        return f

    return register


def _without_maps(rows: DataFrame) -> DataFrame:
    """Whole records; maps become arrays of their entries, which can be compared."""
    return rows.select(*(F.map_entries(c).alias(c) if kind.startswith("map<") else c for c, kind in rows.dtypes))


@_on("questions")
def p3_found(questions):
    return format_dups.format_duplicates(questions)


@_on("questions")
def p3_deduplicated(questions):
    return format_dups.deduplicated(questions).select("id", "source", "copies")


@_on("questions")
def p3_kept_records(questions):
    return _without_maps(format_dups.deduplicated(questions))


_ITEM = r"""
select id, source, regexp_replace(lower(coalesce(stem, '')), '[^\p{L}\p{N}]+', '', 'g') || chr(31) || array_to_string(list_sort(
  list_transform(coalesce(map_values(options), []), lambda x: regexp_replace(lower(coalesce(x, '')), '[^\p{L}\p{N}]+', '', 'g'))), chr(31)) as item
from questions"""

SQL["p3_found"] = f"""
with q as ({_ITEM}), f as (select id, min(id) over (partition by item) as first_id from q)
select distinct first_id, id from f where first_id < id"""

SQL["p3_deduplicated"] = f"""
with q as ({_ITEM}), f as (select id, source, min(id) over (partition by item) as first_id, count(*) over (partition by item) as copies from q)
select id, source, copies from f where id = first_id"""


@_on("questions")
def p7_found(questions):
    return near_dups.near_duplicates(questions)


@_on("questions")
def p7_groups(questions):
    return near_dups.near_duplicate_groups(questions)


@_on("questions")
def p5_found(questions):
    return lookalike.found(questions)


@_on("questions")
def p5_consistent(questions):
    return lookalike.consistent_texts(questions)


@_on("questions")
def p6_found(questions):
    return site_lines.excessive_places(questions)


@_on("questions")
def p6_cleaned(questions):
    return site_lines.without_site_lines(questions).select("id", "source", "stem", "explanation")


_SPACE = r"[\t\x0B\f\r\x{85}\p{Z}]+"
_LINES = f"""
cells as (select id, source, 'stem' as field, stem as text from questions union all select id, source, 'explanation', explanation from questions),
raw as (select id, source, field, unnest(string_split(text, chr(10))) as line, unnest(generate_series(1, len(string_split(text, chr(10))))) as line_no
  from cells where source is not null and text is not null),
lines as (select id, source, field, line_no, trim(regexp_replace(line, '{_SPACE}', ' ', 'g')) as line from raw),
totals as (select source, count(*) as total from questions where source is not null group by source),
often as (select l.source, l.line from lines l join totals t using (source) where l.line <> ''
  group by l.source, l.line, t.total having count(distinct l.id) >= 3 and count(distinct l.id) * 20 >= t.total)"""

SQL["p6_found"] = f"""
with {_LINES} select distinct l.id, l.field, cast(l.line_no as integer) as line_no from lines l join often o on l.source = o.source and l.line = o.line"""

SQL["p6_cleaned"] = f"""
with {_LINES}, kept as (select r.id, r.field, coalesce(string_agg(r.line, chr(10) order by r.line_no)
    filter (where (r.source, trim(regexp_replace(r.line, '{_SPACE}', ' ', 'g'))) not in (select source, line from often)), '') as text
  from raw r group by r.id, r.field)
select q.id, q.source, case when q.source is null or q.stem is null then q.stem else s.text end as stem,
  case when q.source is null or q.explanation is null then q.explanation else e.text end as explanation
from questions q left join kept s on s.id = q.id and s.field = 'stem' left join kept e on e.id = q.id and e.field = 'explanation'"""


# p5 by its definition, in ranges of code points: nothing of the operator's tables goes in here.
_P5_CASE = "|".join(
    (
        r"[\p{Cf}\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]",  # invisible
        r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]",  # spaces other than the plain one
        r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]",  # full-width digits and letters
        r"[\x{300}-\x{36F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}]",  # separate accents
        r"[\x{2E80}-\x{2FDF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}\x{FF66}-\x{FF9D}\x{FB00}-\x{FB06}\x{1D400}-\x{1D7FF}\x{212A}\x{212B}]",  # other blocks of the same characters
        r"[\p{Cyrillic}\p{Cherokee}\p{Lisu}\p{Armenian}ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹɡɑıȷ]",  # other scripts
        r"[ανιορυϲ][A-Za-z]|[A-Za-z][ανιορυϲ]",  # Greek letters inside Latin words
    )
)
_P5_CELLS = " union all ".join(
    f"select id, '{n}' as field, {c} as text from questions"
    for n, c in [("stem", "stem"), ("explanation", "explanation"), *((f"shared-option-{k}", f"shared_options['{k}']") for k in "ABCDE")]
)
SQL["p5_found"] = f"select distinct id, field from ({_P5_CELLS}) where regexp_matches(text, '{_P5_CASE}')"


@_on("documents", "eval_items")
def p8_found(documents, items):
    return contamination.leaks(documents, items)


@_on("documents", "eval_items")
def p8_leaked_items(documents, items):
    return contamination.leaked_items(documents, items)


@_on("documents", "mix_targets")
def p9_mixture(documents, targets):
    return mixing.mixed(documents, targets)


@_on("documents", "mix_targets")
def p9_report(documents, targets):
    return mixing.report(documents, targets)


@_on("documents", "split_limits")
def p10_found(documents, limits):
    return splitting.oversized(documents, limits)


@_on("documents", "split_limits")
def p10_pieces(documents, limits):
    return splitting.pieces(documents, limits)


@_on("questions")
def p2_found(questions):
    return residue.found(questions)


@_on("questions")
def p2_clean_bank(questions):
    return _without_maps(residue.without_residue(questions))


@_on("questions")
def p2_validation(questions):
    return residue.validation(questions)


@_on("questions")
def p1_found(questions):
    return truncation.found(questions)


@_on("questions")
def p1_by_source(questions):
    return truncation.by_source(questions)


@_on("questions")
def p4_found(questions):
    return scan_repair.found(questions)


@_on("questions")
def p4_repaired(questions):
    return scan_repair.repaired_fields(questions)


_GRAMS = r"""
parts as (select id, unnest(list_concat([coalesce(stem, ''), coalesce(explanation, '')], coalesce(map_values(options), []))) as x from questions),
p as (select id, regexp_replace(lower(coalesce(x, '')), '[^\p{L}\p{N}]+', '', 'g') as t from parts),
g as (select distinct id, unnest(list_transform(generate_series(1, length(t) - 2), lambda i: substr(t, i, 3))) as g from p where length(t) >= 3),
n as (select id, count(*) as n from g group by id),
c as (select a.id as id_a, b.id as id_b, count(*) as shared from g a join g b on a.g = b.g and a.id < b.id group by all),
near as (select id_a, id_b, shared = a.n and shared = b.n as equal from c join n a on a.id = id_a join n b on b.id = id_b where shared >= 0.6 * (a.n + b.n - shared))"""

SQL["p7_found"] = f"""
with {_GRAMS}, k as ({_ITEM})
select distinct id_a, id_b from near join k x on x.id = id_a join k y on y.id = id_b where x.item <> y.item"""

SQL["p7_groups"] = f"""
with recursive {_GRAMS}, sides as (select id_a as a, id_b as b, equal from near union all select id_b, id_a, equal from near),
reach(id, other) as (select id, id from questions union select r.id, b.b from reach r join sides b on b.a = r.other),
first as (select id, least(id, min(b)) as content from (select id from questions) left join sides on a = id and equal group by id),
degree as (select a as id, count(distinct f.content) as links from sides join first f on f.id = b where not equal group by a)
select id, min(other) as group_id, coalesce(any_value(links), 0) as links from reach left join degree using (id) group by id"""

_LEAKS = r"""
d as (select doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') as t from documents),
e as (select item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') as t from eval_items),
dw as (select doc_id, unnest(list_transform(generate_series(1, length(t) - 39), lambda i: substr(t, i, 40))) as w from d where length(t) >= 40),
ew as (select distinct item_id, unnest(list_transform(generate_series(1, length(t) - 39), lambda i: substr(t, i, 40))) as w from e where length(t) >= 40),
leaks as (select distinct doc_id, item_id from dw join ew using (w))"""

SQL["p8_found"] = f"with {_LEAKS} select doc_id, item_id from leaks"

SQL["p8_leaked_items"] = f"with {_LEAKS} select item_id, count(*) as documents from leaks group by item_id"


def sql() -> dict[str, str]:
    """The SQL of all queries that have some."""
    return SQL
