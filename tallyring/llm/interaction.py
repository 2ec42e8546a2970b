"""Filter interaction audit: what each of five filters removes under every order of applying them.

Duplicates are found by sorting. Documents are range-partitioned by (text fingerprint, doc_id), so
copies of one text lie over as many tasks as they need, and sorted by (fingerprint, full text,
doc_id); every row is compared with its predecessor. Only the least ids of a task's first
fingerprint depend on tasks before it: they are marked, and settled from one row a task, the least
id of each text of its last fingerprint. The failed filters of a document are a mask of five
bits; counts by part and mask add up, and all 120 orders follow from at most 32 of them a part.

Definitions
  words    maximal ``[^ \\t-\\r]+`` of the whole text; null text is empty.
  A to E   the conditions of :data:`LETTERS`; E: a smaller doc_id has the same text, in any part.
  part     the source; null counts with the empty text.
Rows that repeat a doc_id do not fail E by each other; a null doc_id is smaller than none, and none
is smaller than it. Labels that repeat a doc_id count as their largest. Texts of any length are
counted whole; columns beyond doc_id, source and text are not read, whatever their names. An
empty table gives no rows. doc_id must be a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyring.llm import scratch
from tallyring.llm.text import release

#: Filters by letter; bit i of a mask belongs to letter i.
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
_DUPLICATE = 1 << LETTERS.index("E")
_ROW, _TAIL, _HEAD = 0, 1, 2
_KINDS = {"kind": pa.int8(), "doc_id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "head": pa.int64(), "print": pa.int64(), "text": pa.string()}
_SQL = "kind byte, doc_id long, part string, mask int, head long, print long, text string"


def own_mask(text: str, words: str) -> Column:
    """Bits of the filters that a document fails by itself; ``words`` is the column of its words."""
    n = F.size(words)
    fails = [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(F.col(text), F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        F.col(text).rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def fingerprint(text: str) -> Column:
    """What documents are dealt by; texts are compared whole."""
    return F.xxhash64(text)


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _KINDS.items()], names=[*_KINDS])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by print, text and doc_id (nulls first) to rows with the bit of E, those that an
    earlier task may settle marked with a ``head``; then heads and the task's tails."""
    base = TaskContext.get().partitionId() << 32
    run, leading, previous, least = 0, None, None, None
    tails: dict[int, tuple[str, int]] = {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        prints, text = batch.column("print").to_numpy(), batch.column("text")
        doc, known = batch.column("doc_id"), pc.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(doc, 0).to_numpy()
        same = np.zeros(n, dtype=bool)
        near = 1 + np.flatnonzero(prints[1:] == prints[:-1])
        if len(near):
            same[near] = pc.equal(text.take(pa.array(near)), text.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
        if previous is not None:
            same[0] = previous == (int(prints[0]), text[0].as_py())
        if leading is None:
            leading = int(prints[0])
        # least known id of every run in this batch; the first run may have one from before
        starts = np.flatnonzero(~same | (np.arange(n) == 0))
        which = np.cumsum(~same) - (not same[0])
        first_known = np.minimum.reduceat(np.where(known, np.arange(n), n), starts)
        has = first_known < n
        low = np.where(has, ids[np.minimum(first_known, n - 1)], 0)
        fresh = has.copy()
        if same[0] and least is not None:
            low[0], has[0], fresh[0] = least, True, False
        numbers = run + which + (not same[0])
        copies = known & (ids > low[which])
        open_ = known & ~copies & (prints == leading)
        mask = batch.column("mask").to_numpy() | np.where(copies, _DUPLICATE, 0).astype(np.int32)
        head = pa.array(base + numbers, pa.int64(), mask=~open_)
        yield _batch(kind=np.full(n, _ROW, dtype=np.int8), doc_id=doc, part=batch.column("part"), mask=mask, head=head)
        heads = np.flatnonzero(fresh & (prints[starts] == leading))
        if len(heads):
            at = starts[heads]
            yield _batch(kind=np.full(len(at), _HEAD, dtype=np.int8), doc_id=low[heads], head=base + numbers[at], print=prints[at], text=text.take(pa.array(at)))
        # tails: the texts of the last print so far
        if previous is None or previous[0] != int(prints[-1]):
            tails = {}
        for k in np.flatnonzero(has & (prints[starts] == prints[-1])).tolist():
            tails[int(numbers[starts[k]])] = (text[int(starts[k])].as_py(), int(low[k]))
        run, previous = int(numbers[-1]), (int(prints[-1]), text[n - 1].as_py())
        least = int(low[-1]) if has[-1] else None
    if tails:
        yield _batch(kind=np.full(len(tails), _TAIL, dtype=np.int8), doc_id=[d for _, d in tails.values()], print=[previous[0]] * len(tails), text=[t for t, _ in tails.values()])
    release()


def masks(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, part and mask of the filters it fails; written once."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("print", fingerprint("text")).repartitionByRange("print", "doc_id")
    # masks come after the shuffle, so that its sampling pass does not count words
    own = base.withColumn("words", F.array_remove(F.split("text", "[ \\t-\\r]+"), "")).withColumn("mask", own_mask("text", "words")).drop("words")
    found = scratch.table(own.sortWithinPartitions("print", "text", "doc_id").mapInArrow(_compare, _SQL), "interaction")
    rows = found.where(F.col("kind") == _ROW).select("doc_id", "part", "mask", "head")
    least = found.where(F.col("kind") == _TAIL).groupBy("print", "text").agg(F.min("doc_id").alias("least"))
    heads = found.where(F.col("kind") == _HEAD).select("head", F.col("doc_id").alias("own"), "print", "text").join(least, ["print", "text"])
    copied = heads.where(F.col("least") < F.col("own")).select(F.col("head").alias("of"))
    open_ = rows.where("head IS NOT NULL").join(copied, F.col("head") == F.col("of"), "left")
    settled = open_.select("doc_id", "part", F.when(F.col("of").isNotNull(), F.col("mask").bitwiseOR(F.lit(_DUPLICATE))).otherwise(F.col("mask")).alias("mask"))
    return rows.where("head IS NULL").select("doc_id", "part", "mask").unionByName(settled)


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: additive counts of the rows of :func:`masks`."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(is_one("quality"), is_one("toxic")).where("quality + toxic > 0")
    zero = F.lit(0).cast("long")
    whole = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    marked = rows.join(known, F.col("doc_id") == F.col("of")).groupBy("part", "mask").agg(F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    both = whole.unionByName(marked.select("part", "mask", zero.alias("n"), "good", "toxic"))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def orders(counts: DataFrame) -> DataFrame:
    """Every part, order and step from the counters; a part has 32 of them at most."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(LETTERS))])))
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.ascii(F.substr(F.col("filter_order"), at, F.lit(1))) - ord("A"))
    before = sum((F.when(F.col("step") > i, bit(F.lit(i))).otherwise(F.lit(0)) for i in range(1, len(LETTERS))), F.lit(0))
    steps = steps.withColumns({"own": bit(F.col("step")), "before": before})

    def total(of, condition) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(condition(m["mask"]), of(m)).otherwise(F.lit(0).cast("long")))

    own, past = F.col("own"), F.col("before")
    has = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(past) != 0
    count = lambda c: lambda m: m[c]
    #: of the orders, as many as all over the filters failed have this one before the others failed
    share = lambda m: (m["n"] * len(ORDERS) / F.bit_count(m["mask"])).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(count("n"), lambda m: ~has(m) & ~gone(m)).alias("kept"),
        total(count("n"), lambda m: has(m) & ~gone(m)).alias("removed"),
        total(count("n"), lambda m: has(m) & gone(m)).alias("redundant"),
        total(count("n"), lambda m: m == own).alias("unique_fails"),
        total(count("good"), lambda m: has(m) & ~gone(m)).alias("good_lost"),
        total(count("toxic"), lambda m: has(m) & ~gone(m)).alias("toxic_lost"),
        total(share, has).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley."""
    return orders(counters(masks(docs), labels))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(ws) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
t AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM t a, t b, t c, t d, t e
  WHERE list_unique([a.x, b.x, c.x, d.x, e.x]) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS past FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
m AS (
  SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS has, past <> '' AND translate(fails, past, '') <> fails AS gone FROM s, c),
r AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT has AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN has AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN has AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN has AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN has AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
