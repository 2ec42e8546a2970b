"""Token ids in a content-addressed store.

Each text becomes its ids and one end id. A rolling hash over the last 8 ids cuts the
stream into chunks, so equal passages give equal chunks wherever they stand. The store is
three Parquet tables below one folder:

  chunks    digest (BLAKE2b, 16 bytes), n, ids (little-endian, 2 bytes each if the
            vocabulary allows, else 4). Every distinct chunk once.
  recipes   doc_id, row (unique), n_tokens, digests in order, root (the document's Merkle
            root), part; files in ascending doc_id order, null first, ties by root and row.
  manifest  part, block, docs, tokens, root: Merkle leaves over 1,024 recipes each; ``top``
            hashes them up to one root.

Reading back hashes every stored chunk again and takes its CRC; documents are verified
from their recipes without moving ids (the CRC of a joined stream follows from those of
its parts). The job fails if a chunk is missing or its bytes do not give its digest, if a
recipe's digests do not give its root or its chunks' ids not its n_tokens, and if the leaves
over the recipes are not those of the manifest, or there is no manifest.

Null texts are empty: one end id. Rows with equal ids stay separate documents. A text of any
length is encoded whole. An empty table gives empty tables. Columns beyond doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyring.llm import scratch
from tallyring.llm.text import GOLDEN, RADIX, U64, mix, slices
from tallyring.llm.tokens import SLICE, encoder
from tallyring.llm.tokens import vocabulary as place

LEAST, MOST, MASK, REACH = 256, 8192, U64(1023), 8
END_ID = 0
LEAF = 1024


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def marks(ids: np.ndarray) -> np.ndarray:
    """Places in a stream of ids, possibly of several documents, after which a chunk may end.
    They follow from the last REACH ids, which are of one document from LEAST ids on."""
    h = np.zeros(len(ids), dtype=U64)
    x = mix((ids.astype(U64) + U64(1)) * U64(GOLDEN))
    for j in range(min(REACH, len(ids))):
        h[j:] += x[: len(ids) - j] * U64(pow(RADIX, j, 1 << 64))
    return np.flatnonzero(mix(h) & MASK == 0) + 1


def cuts(places: np.ndarray, at: int, n: int) -> list[int]:
    """Ends of the chunks of the document from ``at`` to ``n`` in a stream with these marks: 256 to
    8,192 ids each, about 1,280 on average."""
    ends = []
    while n - at > LEAST:
        i = int(np.searchsorted(places, at + LEAST))
        end = int(places[i]) if i < len(places) else n
        at = min(end, at + MOST, n)
        ends.append(at)
    return ends if ends and ends[-1] == n else [*ends, n]


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree over digests; the last of an odd level moves up as it is."""
    level = digests or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(1 << 14)
def _x_power(n_bytes: int) -> int:
    """x**(8 n) modulo the CRC-32 polynomial, bits reversed."""
    result, base, n = 1 << 31, 1 << 23, n_bytes
    while n:
        if n & 1:
            result = _multiply(result, base)
        base = _multiply(base, base)
        n >>= 1
    return result


def _multiply(a: int, b: int) -> int:
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        a = (a << 1) & 0xFFFFFFFF
    return out


def crc_join(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a stream from (crc, bytes) of its parts."""
    total = parts[0][0]
    for crc, size in parts[1:]:
        total = _multiply(total, _x_power(size)) ^ crc
    return total


def _cut(id_type: T.DataType, vocabulary: str):
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("seq", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("root", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(place(vocabulary))
        width = coder.dtype.itemsize
        row, seen = TaskContext.get().partitionId() << 36, set()
        kinds = {"row": pa.int64(), "seq": pa.int32(), "n": pa.int32(), "digest": pa.binary(), "ids": pa.binary(), "root": pa.binary()}
        for batch, data, at in slices(batches, "text", SLICE):
            ids, begin = coder.encode(data, at)
            stream = np.insert(ids, begin[1:], END_ID)
            begin = begin + np.arange(len(begin))
            raw, places = stream.tobytes(), marks(stream)
            kept: dict[str, list] = {c: [] for c in schema.names}
            for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                first, digests = len(kept["row"]), []
                for seq, to in enumerate(cuts(places, lo, hi)):
                    part = raw[lo * width : to * width]
                    digests.append(key := digest(part))
                    values = (row, doc, seq, to - lo, key, None if key in seen else part, None)
                    for column, value in zip(kept.values(), values, strict=True):
                        column.append(value)
                    seen.add(key)
                    lo = to
                kept["root"][first] = merkle(digests)
                row += 1
                if len(seen) > 100_000:
                    seen.clear()
            kind = batch.schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays([pa.array(v, type=kinds.get(c, kind)) for c, v in kept.items()], names=list(kept))

    return run, schema


def write(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Encode ``docs`` and write the store's tables below ``path``."""
    spark = docs.sparkSession
    run, schema = _cut(docs.schema["doc_id"].dataType, vocabulary)
    pieces = scratch.table(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces")
    chunks = pieces.where(F.col("ids").isNotNull()).groupBy("digest").agg(F.first("n").alias("n"), F.first("ids").alias("ids"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    order = F.array_sort(F.collect_list(F.struct("seq", "n", "digest")))
    recipes = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), order.alias("c"), F.first("root", ignorenulls=True).alias("root"))
    recipes = recipes.select("doc_id", "row", "n_tokens", F.col("c.digest").alias("digests"), "root")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = recipes.repartitionByRange(wide, "doc_id", "root", "row").sortWithinPartitions("doc_id", "root", "row")
    ordered.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    scratch.drop(pieces)


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with ``start``: the ids of all documents before, in the store's order."""
    found = spark.read.parquet(f"{path}/recipes")
    before, at = {}, 0
    for r in sorted(found.groupBy("part").agg(F.sum("n_tokens")).collect()):
        before[r[0]], at = at, at + r[1]
    offsets = F.broadcast(spark.createDataFrame(list(before.items()), "part int, before long"))  # a row a file
    within = Window.partitionBy("part").orderBy("doc_id", "root", "row").rowsBetween(Window.unboundedPreceding, -1)
    slim = found.select("part", "row", "doc_id", "root", "n_tokens", "digests").withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return slim.join(offsets, "part").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def _chunk_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, keys, crcs = batch.column("n").to_numpy(), batch.column("digest").to_pylist(), []
        for key, count, ids in zip(keys, n, batch.column("ids"), strict=True):
            data = ids.as_buffer()
            if digest(data) != key:
                raise ValueError(f"chunk {key.hex()} does not hold what its digest says")
            if len(data) not in (2 * count, 4 * count):
                raise ValueError(f"chunk {key.hex()} does not hold {count} ids")
            crcs.append(zlib.crc32(np.frombuffer(data, dtype=f"<u{len(data) // count}").astype("<u4")))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def _check_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes with the number of their digests, which must give their roots."""
    for batch in batches:
        counts = []
        for row, digests, root in zip(batch.column("row").to_pylist(), batch.column("digests").to_pylist(), batch.column("root").to_pylist(), strict=True):
            if not digests or merkle(digests) != root:
                raise ValueError(f"the digests of row {row} do not give its root")
            counts.append(len(digests))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "start", "n_tokens")], pa.array(counts, pa.int32())], names=["row", "doc_id", "start", "n_tokens", "n_chunks"])


def _join_crcs(sealed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, parts, want, tokens in zip(*[batch.column(c).to_pylist() for c in ("row", "parts", "n_chunks", "n_tokens")], strict=True):
                if len(parts or ()) != want:
                    raise ValueError(f"row {row} lacks {want - len(parts or ())} of its chunks")
                if sum(p["n"] for p in parts) != tokens:
                    raise ValueError(f"the chunks of row {row} do not hold its {tokens} tokens")
                if not sealed:
                    raise ValueError("the store has no manifest")
                out.append(crc_join([(p["crc"], 4 * p["n"]) for p in parts]))
            i = batch.schema.get_field_index("parts")
            yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in range(i)], pa.array(out, pa.int64())], names=[*batch.schema.names[:i], "ids_crc32"])

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle(x) for x in batch.column("roots").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in range(batch.num_columns - 1)], pa.array(roots, pa.binary())], names=[*batch.schema.names[:-1], "root"])


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    within = Window.partitionBy("part").orderBy("doc_id", "root", "row")
    blocks = spark.read.parquet(f"{path}/recipes").select("part", "doc_id", "root", "row", "n_tokens").withColumn("i", F.row_number().over(within))
    leaves = blocks.groupBy("part", ((F.col("i") - 1) / LEAF).cast("int").alias("block")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("i", "root"))).alias("r"))
    return leaves.select("part", "block", "docs", "tokens", F.col("r.root").alias("roots")).mapInArrow(_roots, "part int, block int, docs long, tokens long, root binary")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Write and return the Merkle leaves over LEAF recipes each."""
    _leaves(spark, path).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _sealed(spark: SparkSession, path: str) -> bool:
    """Whether there is a manifest; fails if its leaves are not those over the recipes."""
    try:
        stored = spark.read.parquet(f"{path}/manifest")
    except AnalysisException:
        return False
    sides = _leaves(spark, path).withColumn("side", F.lit(1)).unionByName(stored.withColumn("side", F.lit(-1)))
    wrong = sides.groupBy("part", "block", "docs", "tokens", "root").agg(F.sum("side").alias("side")).where("side != 0").select("part", "block").limit(3).collect()
    if wrong:
        raise ValueError(f"recipes are not those of the manifest, in (part, block) {sorted({tuple(r) for r in wrong})}")
    return True


def top(spark: SparkSession, path: str) -> bytes:
    """The root over all leaves; a task hashes LEAF of them at most."""
    level = spark.read.parquet(f"{path}/manifest").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("block", "root"))).alias("r"))
    parts = level.select("part", F.col("r.root").alias("roots")).mapInArrow(_roots, "part int, root binary").collect()
    return merkle([bytes(r[1]) for r in sorted(parts, key=lambda r: r[0])])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored files, verified."""
    sealed = _sealed(spark, path)
    crcs = spark.read.parquet(f"{path}/chunks").select("digest", "n", "ids").mapInArrow(_chunk_crcs, "digest binary, n int, crc long")
    docs = recipes(spark, path)
    parts = docs.select("row", F.posexplode("digests").alias("seq", "digest")).join(crcs, "digest")
    joined = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("parts"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = docs.select("row", "doc_id", "start", "n_tokens", "digests", "root").mapInArrow(_check_roots, f"row long, doc_id {kind}, start long, n_tokens long, n_chunks int")
    return whole.join(joined, "row", "left").select("doc_id", "start", "n_tokens", "row", "n_chunks", "parts").mapInArrow(_join_crcs(sealed), f"doc_id {kind}, start long, n_tokens long, row long, n_chunks int, ids_crc32 long").select("doc_id", "start", "n_tokens", "ids_crc32")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = []
        for parts in batch.column("parts").to_pylist():
            ids.append(np.concatenate([np.frombuffer(p["ids"], dtype=f"<u{len(p['ids']) // p['n']}").astype(np.int64) for p in parts]).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids themselves of every document, end id included."""
    docs = recipes(spark, path)
    parts = docs.select("row", F.posexplode("digests").alias("seq", "digest")).join(spark.read.parquet(f"{path}/chunks"), "digest")
    joined = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "ids"))).alias("parts"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "start").join(joined, "row").select("doc_id", "start", "parts").mapInArrow(_join_ids, f"doc_id {kind}, start long, ids array<long>")
