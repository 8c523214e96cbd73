import os

import pytest

import __spark_entry__
from gridloom.plans.carriers import line_pts

SMALL = "/root/testdata/sf0.001"


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_entry_and_some_queries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    for name in ("utm_forward", "grid_contour", "attr_uniq", "ring_assembly"):
        assert __spark_entry__.queries()[name](spark, SMALL).count() > 0


def test_grids_take_size_and_range_from_the_cells(spark, tmp_path):
    """A grid of 3 x 100 cells of elevations 0 to 299."""
    rows = [(k, 150.0 * ((k + 100) if k < 300 else 0), "1-X") for k in range(300)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = __spark_entry__.queries()["grid_resample_nearest"](spark, str(tmp_path)).collect()
    assert {r.i: r.elev for r in got if r.j == 0} == {i: None if 100 * round(2 * i / 59) % 17 == 3 else 100 * round(2 * i / 59) for i in range(60)}
    shades = __spark_entry__.queries()["grid_shade_rescaled"](spark, str(tmp_path)).collect()
    assert max(r.color // 16 for r in shades if r.color // 16 < 10) > 4


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_points_are_made_of_what_was_shuffled(spark):
    """Coordinates are doubles, which do not compress: they are made behind the shuffle by line."""
    below = line_pts(spark, SMALL)._jdf.queryExecution().executedPlan().toString().split("Exchange ", 1)[1]
    assert "l_partkey" in below and "cast(" not in below
