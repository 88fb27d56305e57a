"""Every registered query against its oracle, as the driver does it."""

import duckdb
import pytest

from tidecast import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, con, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} FROM ({plans.oracle_sql()[name].replace('/sf0.01/', '/sf0.001/')})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_all_have_oracles():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_manifest(spark):
    import hashlib
    import os

    got = {r.file: (r.bytes, r.sha256) for r in plans.queries()["file_manifest"](spark, SF).collect()}
    want = {}
    for folder, _, names in os.walk(SF):
        for n in names:
            data = open(f"{folder}/{n}", "rb").read()
            want[n] = (len(data), hashlib.sha256(data).hexdigest())
    assert got == want and "lineitem.parquet" in got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert "verify_summary" in __spark_entry__.queries()
