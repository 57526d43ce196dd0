"""How the pages of ``part`` are dealt out, and what a layout makes of them no more than once."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from labelgrid.functions import vocab as V
from labelgrid.operators import layout as Y
from labelgrid.plans import queries as Q

FOLDER = "/root/testdata/sf0.001"


def test_boxes_lie_with_their_page(spark):
    """Rows of ``part`` are dealt out, not the many boxes made of them."""
    placed = Q.items(spark, FOLDER).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("image_id")))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(p_partkey" in plan


def test_candidates_need_two_classes_only(spark):
    y = Q.layout(spark, FOLDER)
    every, some = Y.clusters(y.classified), Y.clusters(y.classified, Y.SECTIONS)
    assert {r["class"] for r in some.select("class").distinct().collect()} == set(Y.SECTIONS) < set(V.CLUSTERED)
    told = lambda made: sorted(map(str, Y.candidates(made, y.blocks).drop("ord").collect()))
    assert told(some) == told(every)


def test_domains_are_made_once(spark):
    assert Q.domains(spark, FOLDER) is Q.domains(spark, FOLDER)
