"""Choice among the readings of a whole page."""

from labelgrid.operators import ensemble as E


def test_equal_confidences_in_any_order(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ as sums of doubles, not as readings."""
    read = {"original": [0.3, 0.2, 0.1], "clahe": [0.1, 0.2, 0.3]}
    rows = [(i, v, s, "t", c + (0.01 if i == 2 and v == "clahe" else 0.0)) for i in (1, 2) for v, cs in read.items() for s, c in enumerate(cs)]
    rows += [(3, v, 0, "t", None) for v in read] + [(4, v, s, "t", c) for v in read for s, c in enumerate([0.3, None])]
    items = spark.createDataFrame(rows, "image_id int, variant string, seq int, text string, confidence double").coalesce(1)
    quality = spark.createDataFrame([(i, False, True, 30.0) for i in (1, 2, 3, 4)], "image_id int, is_blurry boolean, is_too_dark boolean, contrast_std double")
    chosen = {(r["image_id"], r["variant"]) for r in E.full_page(items, quality).collect()}
    assert chosen == {(1, "original"), (2, "clahe"), (3, "original"), (4, "original")}
