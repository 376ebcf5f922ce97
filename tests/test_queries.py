"""Every query with an SQL twin gives the twin's rows; the others give rows."""
import pytest

import __spark_entry__ as entry
from oracle import compare, connect

HEAVY = {"stage2_models", "gate_run", "demo_multi", "pilot_ladder", "exhaustive_rank", "single_op_sweep", "positive_control",
         "column_headroom", "stage2_compare", "gate_lr", "evaluate_candidate"}     # run by tests/oracle.py
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_registry():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        diff = compare(connect(sf), df, SQL[name])
        assert diff is None or diff == "no rows", diff
    else:
        assert df.count() > 0
