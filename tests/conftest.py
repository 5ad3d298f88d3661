import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from itemweave.schema import ITEM, LETTERS  # noqa: E402
from itemweave.session import local_session, ship  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


@pytest.fixture(scope="session")
def items(spark):
    """A function that makes a bank from dictionaries; what a dictionary leaves out gets a plain value."""
    more = [T.StructField("source", T.StringType()), T.StructField("subject_id", T.StringType()), T.StructField("bank_ord", T.IntegerType())]
    schema = T.StructType(ITEM.fields + more)

    def make(*rows, extra=None):
        out = []
        for n, r in enumerate(rows):
            base = {
                "id": f"2099-U1-{n + 1:03d}", "unit": 1, "number": n + 1, "type": "A1/A2", "stem": f"题干{n}", "options": {k: f"{k}项{n}" for k in LETTERS},
                "answer": "A", "explanation": f"解析{n}。", "source": "s1", "subject_id": "x", "bank_ord": n,
            }
            out.append(base | r)
        df = spark.createDataFrame(out, schema)
        for name, kind in (extra or {}).items():
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
        return df

    return make
