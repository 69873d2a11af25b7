"""Sketches of distinct entities: measured error, merging in any order, late days."""

from pyspark.sql import functions as F

from recallgrid.operators import sketches


def mentions(spark, n):
    r = spark.range(n)
    return r.select((F.col("id") % 3).alias("conversation_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("day"), (F.col("id") % (n // 2)).alias("entity_id"))


def test_error_is_small(spark):
    m = mentions(spark, 200_000)
    exact = {r["conversation_id"]: r["n"] for r in m.groupBy("conversation_id").agg(F.countDistinct("entity_id").alias("n")).collect()}
    for r in sketches.distinct_entities(sketches.daily_sketches(m), "conversation_id").collect():
        assert abs(r["entities"] - exact[r["conversation_id"]]) <= 0.05 * exact[r["conversation_id"]]


def test_merged_sketches_equal_one_pass(spark):
    m = mentions(spark, 20_000).withColumn("late", F.xxhash64("entity_id", "day") % 3 == 0)
    whole = sketches.daily_sketches(m)
    parts = sketches.merged_sketches(sketches.daily_sketches(m.where("not late")), sketches.daily_sketches(m.where("late")))
    of = lambda s: sorted((r["conversation_id"], r["day"], r["entities"], r["n"]) for r in sketches.distinct_entities(s, "conversation_id", "day").collect())
    assert of(whole) == of(parts) and len(of(whole)) == 120
    again = sketches.merged_sketches(parts, sketches.daily_sketches(m))  # what is there twice counts once
    assert [r[2] for r in of(again)] == [r[2] for r in of(whole)]
    assert sketches.distinct_entities(sketches.daily_sketches(m.where("false")), "conversation_id").collect() == []
