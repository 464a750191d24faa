from briefloom.operators import pointing as pt

ANCHOR = "deck_uid int, slide_index int, uid string, kind string, x double, y double, w double, h double, confidence double"


def anchors(spark, *boxes):
    return spark.createDataFrame([(1, 0, u, k, 0.1, y, 0.8, h, c) for u, k, y, h, c in boxes], ANCHOR)


def click(spark, x, y):
    return spark.createDataFrame([(1, 1, 0, x, y)], "gesture_id int, deck_uid int, slide_index int, px double, py double")


def best(spark, a, x, y):
    return pt.point_results(click(spark, x, y), a).head()


def test_block_outranks_the_page(spark):
    a = anchors(spark, ("b", "block", 0.4, 0.08, 1.0)).unionByName(
        spark.createDataFrame([(1, 0, "p", "slide", 0.0, 0.0, 1.0, 1.0, 1.0)], ANCHOR))
    assert best(spark, a, 0.5, 0.44).uid == "b"
    assert best(spark, a, 0.5, 0.8).uid == "p"


def test_near_miss_and_far_click(spark):
    a = anchors(spark, ("b", "block", 0.4, 0.08, 1.0))
    assert best(spark, a, 0.5, 0.39).uid == "b"
    assert best(spark, a, 0.5, 0.9).uid is None


def test_near_tie_is_ambiguous_and_confidence_decides(spark):
    a = anchors(spark, ("a", "block", 0.40, 0.05, 1.0), ("b", "block", 0.45, 0.05, 1.0))
    assert best(spark, a, 0.5, 0.4499).ambiguous
    same = anchors(spark, ("low", "block", 0.4, 0.05, 0.5), ("high", "block", 0.4, 0.05, 1.0))
    assert best(spark, same, 0.5, 0.42).uid == "high"


def test_lasso(spark):
    a = anchors(spark, ("a", "block", 0.40, 0.05, 1.0), ("b", "block", 0.46, 0.05, 1.0), ("c", "block", 0.80, 0.05, 1.0))
    shape = "gesture_id int, deck_uid int, slide_index int, x double, y double, w double, h double"
    full = spark.createDataFrame([(1, 1, 0, 0.0, 0.35, 1.0, 0.2)], shape)
    assert [r.uid for r in pt.lasso(full, a).orderBy("y", "x").collect()] == ["a", "b"]
    clipped = spark.createDataFrame([(1, 1, 0, 0.0, 0.30, 1.0, 0.11)], shape)
    assert pt.lasso(clipped, a).count() == 0
