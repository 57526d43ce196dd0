"""What steps leave in the driver's JVM."""

import pytest

from labelgrid import storage
from labelgrid.llm import common
from labelgrid.operators import parsing as A


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def executed(spark, run):
    """The physical plans of what ``run`` executes."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    made = store.executionsList(int(before), 1000)
    return [made.apply(i).physicalPlanDescription() for i in range(made.size())]


@pytest.mark.parametrize(("module", "step"), [(storage, storage.stage), (common, common.keep)])
def test_finished_steps_leave_no_garbage(spark, monkeypatch, module, step):
    for share, collected in ((1.0, False), (0.0, True)):
        monkeypatch.setattr(module, "HEAP_SHARE", share)
        before = full_collections(spark)
        assert step(spark.range(3).toDF("id")).count() == 3
        assert (full_collections(spark) > before) == collected


def test_terms_are_not_worked_out_by_the_driver(spark):
    terms = spark.sql("SELECT * FROM (VALUES (0, 'A', 'Salt'), (1, 'B', 'SÉA SALT')) AS k(ord, canonical, searchable)")
    tokens = spark.range(2).selectExpr("element_at(array('salt', 'séa salt'), cast(id AS int) + 1) AS phrase")
    told = []
    plans = executed(spark, lambda: told.extend(A.match_terms(tokens, terms).collect()))
    assert {(r["phrase"], r["matched_name"]) for r in told} == {("salt", "A"), ("séa salt", "B")}
    assert not [p for p in plans if "Join" in p and "LocalTableScan" in p]
