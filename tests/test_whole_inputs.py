"""The registered queries read all rows of their tables."""

import duckdb

from stradale.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def test_every_customer_is_snapped(spark):
    names, want = rows_of(ORACLES["nearest_snap"], "supplier", "customer")
    got = [tuple(r) for r in QUERIES["nearest_snap"](spark, SF).select(*names).collect()]
    assert len(want) == len(rows_of("FROM customer", "customer")[1])
    assert sorted(got) == sorted(want)


def test_edges_of_every_order(spark):
    names, want = rows_of(ORACLES["simple_graph_dedup"], "lineitem")
    got = [tuple(r) for r in QUERIES["simple_graph_dedup"](spark, SF).select(*names).collect()]
    assert sorted(got) == sorted(want) and len(want) == 45  # every pair of ten suppliers
