"""Joins over whole tables: no row of a side is left out by its id."""

from lodestone.plans import registry

D = "/root/testdata/sf0.001"


def test_every_row_takes_part(spark):
    run = lambda key: registry.queries()[key](spark, D)
    orders, customers = (spark.read.parquet(f"{D}/{t}.parquet").count() for t in ("orders", "customer"))
    assert run("join_left_outer").where("o_orderkey is not null").count() == orders
    assert run("join_right_outer").select("c_custkey").distinct().where("c_custkey is not null").count() == customers
    full = run("join_full_outer")
    assert full.where("c_custkey is null").count() > 0 and full.where("o_orderkey is null").count() > 0
    pairs = run("join_inner").count()
    assert run("join_semi").count() == pairs > 0 and run("join_anti").count() == orders - pairs > 0
    assert 0 < run("join_null_aware_anti").count() < customers
    flags = {r["matched"]: r["count"] for r in run("join_null_aware_left_outer_semi").groupBy("matched").count().collect()}
    assert set(flags) == {True, None} and sum(flags.values()) == customers
