import pytest
from pyspark.sql import functions as F

from quire import queries as Q
from tests.compare import same


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert same(Q.QUERIES[name](spark, sf_dir), Q.ORACLES[name], sf_dir) > 0


def test_every_branch_is_met(spark, sf_dir):
    routes = {r["route"]: r["blocks"] for r in Q.QUERIES["route_counts"](spark, sf_dir).collect()}
    assert set(routes) == {"trivial", "glossary", "name", "names", "footer", "toc", "body"} and min(routes.values()) > 0
    kinds = {r[0] for r in Q.QUERIES["block_kinds"](spark, sf_dir).select("kind").distinct().collect()}
    assert {"table", "toc", "tocln", "skipped", "single", "multi"} <= kinds
    extracted = {r["kind"]: r["n"] for r in Q.QUERIES["extract_blocks"](spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(extracted) >= {"toc", "tocln", "single", "multi"}
    assert {r[0] for r in Q.QUERIES["eval_diff"](spark, sf_dir).collect()} == {"same", "changed", "only_a", "only_b"}


def test_routes_add_up(spark, sf_dir):
    rows = Q.QUERIES["route_blocks"](spark, sf_dir)
    assert sum(r["blocks"] for r in Q.QUERIES["route_counts"](spark, sf_dir).collect()) == rows.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
