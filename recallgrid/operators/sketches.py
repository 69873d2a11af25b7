"""Distinct counts that are kept and merged: a sketch for each day and conversation, instead of all mentions again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query, read

#: Logarithm of a sketch's registers: 2 ** 12 give a relative error of about 1.6 %.
REGISTERS = 12


def daily_sketches(mentions: DataFrame, day: str = "day", conversation: str = "conversation_id", entity: str = "entity_id", registers: int = REGISTERS) -> DataFrame:
    """(conversation, day, sketch, n): a mergeable sketch of the entities mentioned, and how many mentions there were."""
    return mentions.groupBy(conversation, day).agg(F.hll_sketch_agg(entity, registers).alias("sketch"), F.count("*").alias("n"))


def merged_sketches(kept: DataFrame, new: DataFrame, day: str = "day", conversation: str = "conversation_id") -> DataFrame:
    """The sketches kept, with those of new mentions (of late days, too) merged into them; no mention is read again."""
    return kept.unionByName(new).groupBy(conversation, day).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))


def distinct_entities(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, entities, n): the estimated number of different entities, and of mentions, of each group of sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("entities"), F.sum("n").alias("n"))


@query("count_entities_sketch", "SELECT o_orderpriority AS conversation_id, year(o_orderdate) AS year, count(*) AS n, count(DISTINCT l_partkey) AS exact, true AS close FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def _sketched(spark, d):
    """Parts of each priority and year, from sketches by day: those of the later half of the orders are merged in."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("conversation_id"), F.col("o_orderdate").cast("date").alias("day"))
    m = read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("conversation_id", "day", F.col("l_partkey").alias("entity_id"), "o_orderkey")
    odd = F.col("o_orderkey") % 2 == 1
    sketches = merged_sketches(daily_sketches(m.where(~odd)), daily_sketches(m.where(odd)))
    year = F.year("day").cast("long").alias("year")
    found = distinct_entities(sketches.select("conversation_id", year, "sketch", "n"), "conversation_id", "year")
    exact = m.groupBy("conversation_id", year).agg(F.countDistinct("entity_id").alias("exact"))
    close = F.abs(F.col("entities") - F.col("exact")) <= 1 + 0.07 * F.col("exact")
    return found.join(exact, ["conversation_id", "year"]).select("conversation_id", "year", "n", "exact", close.alias("close"))
