"""Registered queries do the whole job."""

import duckdb
import pytest

from tidecast import plans
from tidecast.functions import crps_sql
from tidecast.plans.testbed import OBS, fc, mom

SF = "/root/testdata/sf0.001"


def test_simulations_draw_the_references_paths(spark):
    assert plans.queries()["ecc_reorder"](spark, SF).select("path").distinct().count() == 10_000
    rates = [r.rate * 10_000 for r in plans.queries()["event_probs"](spark, SF).collect()]
    assert any(round(x) % 20 for x in rates)
    assert {r.horizon for r in plans.queries()["fsm_paths_long"](spark, SF).select("horizon").distinct().collect()} == set(range(1, 41))


def test_every_origin_has_a_fit_of_its_own(spark):
    got = {(r.indicator, r.origin): (r.n, r.crps) for r in plans.queries()["multi_origin_crps"](spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    want = {}
    for o in plans._ORIGINS:
        sql = f"WITH {OBS}, {mom(o)}, {fc()} SELECT fc.indicator, count(*), avg({crps_sql('obs.value', 'q50', plans.SM)}) FROM fc JOIN obs ON obs.indicator = fc.indicator AND obs.t = {o} + horizon WHERE obs.value IS NOT NULL GROUP BY ALL"
        want |= {(i, o): (n, pytest.approx(x, abs=0.01)) for i, n, x in con.execute(sql).fetchall()}
    assert got == want
