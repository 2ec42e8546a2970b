"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document gets a 40-bit hash of its id. Sizes are summed by source and by the first
10 bits of the hash; running sums over those 1,024 buckets find the bucket in which a
source's budget ends. Only that bucket is summed again by the next 10 bits, and so on
over four nested levels, so the last bucket holds about one document at any input size.
A document is taken if its hash lies below its source's threshold: no sort, no rank. What is
known of sources is a table of one row a source, written after each level; it never comes to the
driver, and Spark broadcasts it where it is small.

Definitions
  size        number of words ``[^ \\t-\\r]+`` of the text; null counts 0.
  weights     sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ...
  target      a source's share by weight of all sizes, at most 3 times its own size; what is
              cut off is shared again by weight among the others until none is above.
  copies      ``floor(target / source_size)``, plus 1 if the hash is below the threshold.
  taken       ``copies * size``.
Rows with the same id share a hash and so a decision; a null id hashes as the empty text.
Empty documents are copied by the same rule and count 0. A source without words has
target 0 and no copies; an empty table gives an empty result. Texts of any length are counted
whole, repeated rows one by one; columns beyond doc_id, source and text are not read, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MOST = 3
BITS, LEVELS = 10, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def hash40(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 10), 16, 10).cast("long")


def sized(docs: DataFrame, *kept: Column) -> DataFrame:
    """source, size and hash of every document, after the columns that are kept."""
    return docs.select(*kept, "source", word_count(F.col("text")).alias("size"), hash40(F.col("doc_id")).alias("hash"))


def targets(sums: DataFrame) -> DataFrame:
    """``sums`` (source, total: one row a source) with ``target``: shares of all by weight, none above
    MOST times its source's total. Sources are cut off in order of total by weight, so sums
    over that order tell where the cutting ends."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = reduce(lambda c, iw: c.when(place % len(WEIGHTS) == iw[0], F.lit(iw[1])), enumerate(WEIGHTS), F.when(F.lit(False), F.lit(0)))
    most = F.col("total") * MOST
    order = Window.orderBy((most.cast("double") / F.col("weight")).asc(), F.asc_nulls_last("source"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sums.withColumn("weight", weight).withColumns({"all": F.sum("total").over(every), "before": F.coalesce(F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    out = out.withColumn("cut", (F.col("all") - F.col("before")) * F.col("weight") > most * F.col("rest"))
    room = (F.col("all") - F.coalesce(F.sum(F.when(F.col("cut"), most)).over(every), F.lit(0))).cast("double")
    shares = F.sum(F.when(~F.col("cut"), F.col("weight"))).over(every).cast("double")
    return out.withColumns({"room": room, "shares": shares}).select("source", "total", F.when(F.col("cut"), most.cast("double")).otherwise(F.col("room") / F.col("shares") * F.col("weight")).alias("target"))


def thresholds(slim: DataFrame, keep) -> DataFrame:
    """One row a source: its total, target, full copies and hash threshold (``prefix``).

    ``slim`` has source, size and hash and is read five times; ``keep`` stores a small table."""
    own = targets(slim.groupBy("source").agg(F.sum("size").alias("total")))
    full = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)).cast("long")
    own = own.withColumn("full", full).withColumn("left", F.col("target") - F.col("full") * F.col("total"))
    state = keep(own.select(F.col("source").alias("of"), "total", "target", "full", "left", F.lit(0).cast("long").alias("prefix")))
    for level in range(LEVELS):
        below = BITS * (LEVELS - level - 1)
        open_ = slim.join(state, F.col("source").eqNullSafe(F.col("of"))).where(F.shiftright("hash", below + BITS) == F.col("prefix"))
        sums = open_.groupBy("of", F.shiftright("hash", below).alias("step")).agg(F.sum("size").alias("n"), F.max("left").alias("budget"))
        running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("of").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
        edge = running.where(F.col("upto") > F.col("budget")).groupBy(F.col("of").alias("at")).agg(F.min(F.struct("step", "n", "upto")).alias("e"))
        left = F.col("left") - (F.col("e.upto") - F.col("e.n"))
        # the last bucket is taken if that comes nearer to the budget
        nearer = (F.col("e.n") - left < left).cast("long") if level == LEVELS - 1 else F.lit(0).cast("long")
        # no edge: nothing is beyond the budget here, so everything below this prefix's end is taken
        prefix = F.when(F.col("e").isNotNull(), F.col("e.step") + nearer).when(F.col("total") > 0, F.call_function("shiftleft", F.col("prefix") + 1, F.lit(BITS))).otherwise(F.lit(0).cast("long"))
        state = keep(state.join(edge, F.col("of").eqNullSafe(F.col("at")), "left").select("of", "total", "target", "full", F.coalesce(left, F.col("left")).alias("left"), prefix.alias("prefix")))
    return state


def copies() -> Column:
    """How often a row is taken."""
    return F.when(F.col("total") > 0, F.col("full") + (F.col("hash") < F.col("prefix")).cast("long")).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, keep) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; ``keep`` stores a DataFrame for
    rereading (texts are read once)."""
    slim = keep(sized(docs, F.col("doc_id")))
    joined = slim.join(thresholds(slim.drop("doc_id"), keep), F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "size", F.col("total").alias("source_size"), "target", (copies() * F.col("size")).alias("taken"))


def resample(docs: DataFrame, keep) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it; columns as they came."""
    state = thresholds(keep(sized(docs)), keep)
    # a row goes along whole, so none of its columns can clash
    joined = sized(docs, F.struct("*").alias("row")).join(state, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies())
    return joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS v
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS ssize,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(ssize) OVER () AS total,
         coalesce(sum(3 * ssize) OVER (ORDER BY 3.0 * ssize / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY 3.0 * ssize / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s),
c AS (SELECT *, (total - before) * w > 3 * ssize * rest AS capped FROM o),
g AS (SELECT (max(total) - coalesce(sum(3 * ssize) FILTER (capped), 0))::DOUBLE AS room, (sum(w) FILTER (NOT capped))::DOUBLE AS shares FROM c),
t AS (
  SELECT source, ssize, target, CASE WHEN ssize > 0 THEN floor(target / ssize) ELSE 0 END AS full_copies
  FROM (SELECT source, ssize, CASE WHEN capped THEN (3 * ssize)::DOUBLE ELSE room / shares * w END AS target FROM c, g)),
b AS (
  SELECT source, v, n, sum(n) OVER (PARTITION BY source ORDER BY v) AS upto
  FROM (SELECT source, v, sum(size) AS n FROM d GROUP BY source, v)),
k AS (
  SELECT t.source, max(CASE WHEN upto <= left_over OR (upto - n <= left_over AND upto - left_over < left_over - (upto - n)) THEN b.v ELSE -1 END) AS last_v
  FROM b JOIN (SELECT *, target - full_copies * ssize AS left_over FROM t) t ON b.source IS NOT DISTINCT FROM t.source GROUP BY t.source)
SELECT d.doc_id, d.size, t.ssize AS source_size, t.target,
       (CASE WHEN t.ssize > 0 THEN (t.full_copies + (d.v <= k.last_v)::INT) * d.size ELSE 0 END)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN k ON k.source IS NOT DISTINCT FROM t.source
"""
