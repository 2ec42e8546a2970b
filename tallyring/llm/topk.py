"""Exact top-k by inner product: elimination by a table of distances to pivots.

Every vector keeps its distances to the origin and to 31 pivots. For a query q and a vector x,
``|d(q, p) - d(x, p)| <= d(q, x)`` for every pivot p; the largest of these bounds gives
``q.x <= (|q|^2 + |x|^2 - bound^2) / 2``. A block of vectors is passed over where none of its
rows can reach a query's tenth best score; in the others, vectors are scored exactly in order of
their bounds until the next cannot reach it.

Vectors are dealt into blocks by nearest pivot, and by a hash within large ones; queries into
blocks by a hash. Queries meet the block nearest to them first, which gives each a tenth best
score to beat, then every block. A task holds one block of each; tables of vectors and
queries are written once, and only the best of every block go on.

Definitions
  vector   ``floor(1024 * x)`` of every component x as double; shorter vectors are as if padded
           with zeros; an empty vector is all zeros.
  skipped  rows whose vector is null or holds null, NaN or infinity, and rows without an id.
  query    every row whose id is divisible by 100; a repeated id asks once a row.
  others   every row but the query's own; rows that repeat its id are others. Copies count one by one.
  order    higher scores first, then smaller ids.
Scores outside 64-bit integers raise OverflowError. Sums of products are taken in doubles only
where they are exact there. Columns beyond vec_id and embedding are not read. An empty table, or
one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyring.llm import scratch

SCALE, EVERY = 1024, 100
#: Pivots, and the rows (those with the smallest hashes) from which they are chosen.
PIVOTS, SAMPLE = 32, 1024
#: Rows of a block of vectors and of queries.
BLOCK, QUERY_BLOCK = 8192, 16384
#: Candidates scored at once, doubled while bounds allow more.
FIRST = 64
#: Relative error of a kept distance, twice that of 32-bit floats.
ROUNDING = 1.2e-7
_BEST = "query long, query_id long, score long, vec_id long, uid long"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column without nulls, zeros behind short ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().cast(pa.float64()).to_numpy(), pc.list_value_length(column).to_numpy()
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def integers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow list column as whole numbers."""
    with np.errstate(over="ignore"):
        return np.floor(matrix(column) * SCALE)


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return _padded(a, width), _padded(b, width)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of x to the pivots, one column a pivot."""
    x, p = _same_width(x, pivots)
    return np.stack([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in p], axis=1)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """The origin, then each time the row of the sample that is farthest from those chosen."""
    chosen = [np.zeros(sample.shape[1])]
    least = np.full(len(sample), np.inf)
    while len(chosen) < n and len(sample):
        least = np.minimum(least, distances(sample, chosen[-1][None])[:, 0])
        if not least.max() > 0:
            break
        chosen.append(sample[int(least.argmax())])
    return np.stack(chosen)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q as 64-bit integers."""
    with np.errstate(over="ignore"):
        largest = float(np.sqrt((x * x).sum(axis=1).max(initial=0.0)) * np.sqrt((q * q).sum()))
    if largest < 2**52:  # no partial sum is larger, so doubles hold every one exactly
        return (x @ q).astype(np.int64)
    scores = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    if any(not -(2**63) <= s < 2**63 for s in scores):
        raise OverflowError("an inner product is outside 64-bit integers")
    return np.array(scores, dtype=np.int64)


def most(squares: np.ndarray, gap: np.ndarray, error: np.ndarray, q_square: float) -> np.ndarray:
    """Upper bounds of inner products from squared lengths and gaps of pivot distances, which may be
    off by ``error``; rounding never makes a bound too small."""
    with np.errstate(over="ignore", invalid="ignore"):
        least = np.maximum(gap - error, 0)
        total = squares + q_square
        bound = (total - np.where(np.isfinite(least), least, 0) ** 2) / 2 + 1e-9 * total + 1
    return np.where(np.isnan(bound), np.inf, bound)


class Candidates:
    """A block of vectors with its pivot table."""

    def __init__(self, uid: np.ndarray, vec_id: np.ndarray, vec: np.ndarray, dist: np.ndarray) -> None:
        self.uid, self.vec_id, self.vec, self.dist = uid, vec_id, vec, dist
        with np.errstate(over="ignore"):
            self.squares = (vec * vec).sum(axis=1)
        self.low, self.high, self.farthest = dist.min(axis=0), dist.max(axis=0), dist.max(axis=1)

    def best(self, uid: int, q: np.ndarray, q_dist: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best here, none needed below ``floor``."""
        with np.errstate(over="ignore"):
            q_square = float((q * q).sum())
        # of a whole block: its largest square, and the distance from its ranges of pivot distances
        least = -np.inf if floor is None else floor
        with np.errstate(invalid="ignore"):
            error = ROUNDING * (self.farthest + q_dist.max())
            gap = np.maximum(self.low - q_dist, q_dist - self.high).max()
            if most(self.squares.max(), gap, error.max(), q_square) < least:
                return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            bounds = most(self.squares, np.abs(self.dist - q_dist).max(axis=1), error, q_square)
        order = np.flatnonzero((bounds >= least) & (self.uid != uid))
        order = order[np.argsort(-bounds[order], kind="stable")]
        at, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        done, step = 0, FIRST
        # bounds fall along the order, and equal scores may win by id: stop only strictly below
        while done < len(order) and not bounds[order[done]] < least:
            now = order[done : done + step]
            at, scores = np.append(at, now), np.append(scores, exact(self.vec[now], q))
            keep = np.lexsort((self.uid[at], self.vec_id[at], -scores))[:k]
            at, scores = at[keep], scores[keep]
            if len(at) == k:
                least = max(least, int(scores[-1]))
            done, step = done + step, step * 2
        return at, scores


def _meet(k: int):
    """Best k of a block of vectors for every query of a block."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if queries.num_rows and vectors.num_rows:
            v, q = _same_width(integers(vectors.column("embedding")), integers(queries.column("embedding")))
            block = Candidates(vectors.column("uid").to_numpy(), vectors.column("vec_id").to_numpy(), v, matrix(vectors.column("dist")))
            ids, uids, floors = (queries.column(c).to_pylist() for c in ("vec_id", "uid", "floor"))
            q_dist = matrix(queries.column("dist"))
            for i, uid in enumerate(uids):
                at, scores = block.best(uid, q[i], q_dist[i], k, floors[i])
                found += [(uid, ids[i], s, int(block.vec_id[a]), int(block.uid[a])) for a, s in zip(at.tolist(), scores.tolist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "score", "vec_id", "uid"])

    return run


def _index(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("embedding"))
                dist = distances(x, pivots)
                # the origin is no cluster of its own unless it is the only pivot
                near = dist[:, 1:].argmin(axis=1) if len(pivots) > 1 else np.zeros(len(x), dtype=np.int64)
                at = np.arange(0, dist.size + 1, dist.shape[1], dtype=np.int32)
                with np.errstate(over="ignore"):
                    kept = pa.ListArray.from_arrays(pa.array(at), pa.array(dist.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, kept, pa.array(near, pa.int32())], names=[*batch.schema.names, "dist", "near"])

    return run


def whole_vectors(table: DataFrame) -> DataFrame:
    """uid, vec_id and embedding of the rows that take part."""
    x = F.col("embedding")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))), F.lit(False))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(sound & F.col("vec_id").isNotNull())
    return rows.withColumn("uid", F.monotonically_increasing_id())


def pivot_table(table: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """The index of every vector, written once: vec_id, embedding, uid, dist (a distance a pivot), near."""
    rows = scratch.table(whole_vectors(table), "vectors")
    few = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("h"), "uid").orderBy("h", "uid").limit(sample).select("embedding").toArrow()
    chosen = choose_pivots(integers(few.column("embedding").combine_chunks()), pivots)
    kind = rows.schema["embedding"].dataType.simpleString()
    return scratch.table(rows.mapInArrow(_index(chosen), f"vec_id long, embedding {kind}, uid long, dist array<float>, near int"), "pivots")


def _cells(index: DataFrame, block: int, query_block: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Vectors and queries with their blocks, and the numbers of blocks. A count a pivot is collected."""
    sizes = dict(index.groupBy("near").count().collect())
    parts = [max(1, -(-sizes.get(i, 0) // block)) for i in range(max(sizes, default=0) + 1)]
    begin, spread = F.array(*[F.lit(int(b)) for b in np.cumsum([0, *parts[:-1]])]), F.array(*map(F.lit, parts))
    at = F.get(begin, F.col("near")) + F.pmod(F.xxhash64("uid"), F.get(spread, F.col("near")).cast("long")).cast("int")
    # columns of their own, as both sides of a cogroup may not share any
    queries = index.where(F.pmod("vec_id", F.lit(EVERY)) == 0).select(*[F.col(c).alias(f"q_{c}") for c in index.columns])
    queries = queries.toDF(*index.columns)
    n = max(1, -(-queries.count() // query_block))
    asked = queries.withColumns({"block": at, "part": F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")})
    return index.withColumn("block", at), asked, sum(parts), n


def _every(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def search(table: DataFrame, k: int = 10, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best others of every query, exactly."""
    index = pivot_table(table, pivots, sample)
    vectors, queries, blocks, parts = _cells(index, block, query_block)
    meet, cell = _meet(k), ["block", "part"]
    spread = vectors.select("uid", "vec_id", "embedding", "dist", "block", _every(parts).alias("part"))
    first = queries.withColumn("floor", F.lit(None).cast("long"))
    near = first.groupBy(*cell).cogroup(spread.groupBy(*cell)).applyInArrow(meet, _BEST)
    # a full k of scores from one block bounds the k-th best of all from below
    floors = near.groupBy(F.col("query").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).select("of", F.when(F.col("n") >= k, F.col("low")).alias("floor"))
    bounded = scratch.table(queries.drop("block").join(floors, F.col("uid") == F.col("of"), "left").drop("of"), "asked")
    everywhere = bounded.withColumn("block", _every(blocks))
    best = everywhere.groupBy(*cell).cogroup(spread.groupBy(*cell)).applyInArrow(meet, _BEST)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("uid")))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
