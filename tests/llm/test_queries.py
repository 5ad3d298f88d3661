from pathlib import Path

import pytest

from itemweave.llm import queries as llm
from tests.test_entry import SMALL, compare

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, name):
    sql = llm.sql()
    if name in sql:
        compare(spark, name, llm.QUERIES[name], sql[name])
    else:
        df = llm.QUERIES[name](spark, SMALL)
        assert df.count() == df.distinct().count()


COLUMNS = {
    "p1_found": ["id"], "p2_found": ["id"], "p3_found": ["first_id", "id"], "p4_found": ["id", "field"], "p5_found": ["id", "field"], "p6_found": ["id", "field", "line_no"],
    "p7_found": ["id_a", "id_b"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert llm.QUERIES[name](spark, SMALL).columns == COLUMNS[name]


@pytest.mark.parametrize(("name", "more"), [("p2_clean_bank", []), ("p3_kept_records", ["copies"])])
def test_whole_records(spark, name, more):
    bank = spark.read.parquet(f"{SMALL}/questions.parquet")
    bank = bank.selectExpr(*(f"map_entries({c}) as {c}" if kind.startswith("map<") else c for c, kind in bank.dtypes))
    got = llm.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(bank.columns + more)
    assert got.count() > 0 and got.select(bank.columns).exceptAll(bank).count() == 0
