"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weights, repeating, of the sources in code-point order.
WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = "mix"


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes(src, src_null, size) -> one row per source with weight, source_size and target.

    Targets share the sum of all sizes by weight; none passes EPOCHS times its source's size, and the excess is shared
    again by weight (water filling in closed form: sources by cap/weight, the capped ones are a prefix).
    """
    one = sizes.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("src_null", "src")
    one = one.withColumn("ord", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("ord") - 1) % len(WEIGHTS) + 1).cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "ord")
    one = one.withColumn("cap", EPOCHS * F.col("source_size")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    one = one.withColumn("caps_before", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    one = one.withColumn("weights_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    one = one.withColumn("capped", F.col("cap") * F.col("weights_left") <= (F.col("total") - F.col("caps_before")) * F.col("weight"))
    every = Window.partitionBy()
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left.cast("double") * F.col("weight") / free)
    return one.withColumn("target", F.round(target, 6)).select("src_null", "src", "ord", "weight", "source_size", "total", "target")


def weighted_fair_mix(docs: DataFrame) -> DataFrame:
    """Return doc_id, size, source_size, target and taken for every row of documents.

    Shuffled documents (by md5 of doc_id) get the virtual finish time (words of the source up to here) / target, at the
    document's middle so that the last one is taken when most of it fits, over up to three rounds of each source; all copies are sorted by finish time and cut at the total budget, the sum of all
    sizes. Prefix sums run in two levels (source and first 12 bits of the hash, then the rest), so a source with a third
    of the rows is spread over 4,096 groups and only bucket sums meet. The cut sorts 2**16 finish buckets a unit.

    Null text: size 0, taken 0. Null source: a source of its own, last. Repeated doc_ids: a row each, ties broken by
    size. Empty table: empty result. Other columns are ignored.
    """
    sizes = docs.select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit("")).alias("src"), F.col("source").isNull().cast("int").alias("src_null"),
        F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffled"),
    )
    sizes = cut(sizes.withColumn("slot", F.substring("shuffled", 1, 3)))
    targets = cut(source_targets(sizes))
    slots = sizes.groupBy("src_null", "src", "slot").agg(F.sum("size").alias("slot_size"))
    in_order = Window.partitionBy("src_null", "src").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("before", F.sum("slot_size").over(in_order) - F.col("slot_size")).drop("slot_size")
    within = Window.partitionBy("src_null", "src", "slot").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = sizes.join(slots, ["src_null", "src", "slot"]).withColumn("upto", F.col("before") + F.sum("size").over(within))
    lined = lined.withColumn("copy", F.row_number().over(Window.partitionBy("src_null", "src", "slot").orderBy("shuffled", "doc_id", "size")))
    lined = cut(lined.join(targets, ["src_null", "src"]).drop("before"))
    copies = lined.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto") - F.col("size") / 2) / F.col("target"))
    copies = copies.withColumn("tick", F.floor(F.least(F.col("finish"), F.lit(4.0)) * 65536).cast("long"))
    ticks = copies.groupBy("tick").agg(F.sum("size").alias("tick_size"), F.max("total").alias("total"))
    upto = F.sum("tick_size").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0))
    edge = ticks.select("tick", (upto - F.col("tick_size")).alias("tick_before"), upto.alias("tick_upto"), "total").where("tick_upto > total").agg(F.min("tick").alias("edge"), F.min("tick_before").alias("edge_before"))
    copies = copies.crossJoin(F.broadcast(edge))  # one row
    last = Window.partitionBy("tick").orderBy("finish", "ord", "shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = copies.where("tick = edge").withColumn("running", F.col("edge_before") + F.sum("size").over(last)).where("running <= total").drop("running")
    kept = copies.where("edge is null or tick < edge").unionByName(at_edge)
    taken = kept.groupBy("src_null", "src", "slot", "copy").agg(F.sum("size").alias("taken"))
    return lined.join(taken, ["src_null", "src", "slot", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: The same rows by global windows, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') src, CASE WHEN source IS NULL THEN 1 ELSE 0 END src_null,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT size, md5('mix' || coalesce(doc_id::VARCHAR, '')) shuffled FROM documents),
s AS (SELECT src_null, src, sum(size)::BIGINT source_size FROM d GROUP BY ALL),
w AS (SELECT *, row_number() OVER (ORDER BY src_null, src) ord FROM s),
w2 AS (SELECT *, ((ord - 1) % 3 + 1)::BIGINT weight, 3 * source_size cap, sum(source_size) OVER () total FROM w),
w3 AS (SELECT *, sum(cap) OVER (ORDER BY source_size / weight::DOUBLE, ord ROWS UNBOUNDED PRECEDING) - cap caps_before,
    sum(weight) OVER (ORDER BY source_size / weight::DOUBLE, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) weights_left FROM w2),
w4 AS (SELECT *, cap * weights_left <= (total - caps_before) * weight capped FROM w3),
t AS (SELECT src_null, src, ord, source_size, total, round(CASE WHEN capped THEN cap::DOUBLE ELSE
    (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE * weight / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END, 6) target FROM w4),
l AS (SELECT d.*, sum(size) OVER (PARTITION BY src_null, src ORDER BY shuffled, doc_id ROWS UNBOUNDED PRECEDING) upto FROM d),
c AS (SELECT l.doc_id, l.size, t.ord, t.total, l.shuffled, ((e.range * t.source_size + l.upto)::DOUBLE - l.size::DOUBLE / 2) / t.target finish
    FROM l JOIN t USING (src_null, src) CROSS JOIN range(3) e WHERE l.size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, ord, shuffled, doc_id ROWS UNBOUNDED PRECEDING) running FROM c),
k AS (SELECT doc_id, sum(size)::BIGINT taken FROM r WHERE running <= total GROUP BY doc_id)
SELECT l.doc_id, l.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT taken FROM l JOIN t USING (src_null, src) LEFT JOIN k ON k.doc_id = l.doc_id
"""
