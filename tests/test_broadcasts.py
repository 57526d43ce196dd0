"""No table that grows with the pages is gathered by the driver to be broadcast."""

import re

import pytest

from labelgrid import storage
from labelgrid.operators import classify as C
from labelgrid.plans.queries import QUERIES, forget

SF = "/root/testdata/sf0.001"
#: queries that once did
CURED = [
    "o09_o103_result_json",
    "o34_line_classes",
    "o42_o59_o35_blocks",
    "o46_o78_anchors",
    "o61_o77_candidates",
    "o63_o95_nutrition_expansions",
    "o90_ingredient_tokens",
    "o100_nutrition_regions",
    "o10_result_text",
    "o28_o99_ingredient_regions",
    "o43_o60_clusters",
    "o48_o65_terms_per_page",
    "o62_o94_ingredient_expansions",
    "o64_o96_nutrition_row_tables",
    "o67_quality",
    "o69_o73_columns",
    "o82_o85_sets",
    "o88_corrected",
    "o97_block_fallbacks",
]


def broadcast_keys(spark, run):
    """The keys of every broadcast join of what ``run`` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    made = store.executionsList(int(before), 1000)
    plans = [made.apply(i).physicalPlanDescription() for i in range(made.size())]
    assert plans
    return [k for p in plans for k in re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[([^\n]*)\]", p)]


@pytest.mark.parametrize("name", CURED)
def test_pages_are_not_broadcast(spark, name):
    forget(spark)  # what other tests made of the pages is made anew
    keys = broadcast_keys(spark, lambda: QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    assert not [k for k in keys if "image_id" in k]


def test_only_few_texts_are_broadcast(spark, monkeypatch):
    lines = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)] + [(50, None)], "id int, text string")
    told = lambda: C.on_texts(lines, "text", {"size": "length(t0)"}).select("id", "size").collect()
    keys, rows = broadcast_keys(spark, told), sorted(told())
    assert any("text" in k for k in keys) and len(rows) == 51 and rows[50]["size"] == 0
    for limit in ("LOOKUP_ROWS", "LOOKUP_CHARS"):
        with monkeypatch.context() as m:
            m.setattr(storage, limit, 6)
            assert not broadcast_keys(spark, told) and sorted(told()) == rows
