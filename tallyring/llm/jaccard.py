"""N-gram Jaccard join: documents whose shingle sets have a Jaccard similarity of 0.85 or more.

Sets: A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+``; distinct sequences of 4 words, as 64-bit
hashes; with fewer words, the whole sequence as one. Two documents link when
``100 * |intersection| >= 85 * |union|``.

1. Documents with equal sets are one class, spoken for by its smallest doc_id. Whatever
   follows sees a class once, so exact copies cost nothing further.
2. Tokens (shingles) stand in order of their hashes. A similar set misses fewer than
   ``p = n - ceil(0.85 n) + 1`` tokens of a set of n. Prefixes are extended by half: the first
   ``p + e`` tokens, ``e = ceil(p / 2)``. Tokens in over ``RARE`` of these prefixes are frequent;
   they are kept as a bit map of fixed size, so some rare ones count as frequent too, for all
   sets alike.
3. Rare tokens are indexed singly: the first p rare tokens of each prefix. Two similar sets
   share one of them, or else share ``e + 1`` frequent tokens of their prefixes. Sets with fewer
   frequent ones are done.
4. The others take whole sets: tokens in over RARE of these sets are frequent now, rare tokens
   stand first in the order, and prefixes are cut anew. A set with p rare tokens is done by its
   rare ones; so boilerplate that many documents share joins none of them. The rest is indexed
   by combinations of two frequent tokens of the extended prefix: tokens fall into g <= e classes
   by hash, and two of the e + 1 must meet in a class. Keys hold a level of sizes (a level is
   0.85 of the next; a set is indexed under its own and the next), so sets of unlike sizes
   never meet.
5. Sets that share a rare token make pairs (a token has RARE sets at most); how many tokens a
   pair shares, and how many it could, bounds the intersection, which leaves little but true
   copies. Sets that share a combination only name its smallest set. Both kinds of candidates
   join sets to clusters.
6. Clusters are verified exactly. Each set is compared with its cluster's smallest; those that
   link are joined by that, however many they are. Distance (1 - similarity) is a metric, so of
   those linked only the ones that could be near a set left over take part further. What is left
   is compared in blocks by inverted lists, two linked ones never with each other. Clusters are
   dealt in parts of ``PART`` sets and in pairs of ``BLOCK`` (fewer if texts are long), whatever
   their size.
7. Before that, what is left of a cluster of more than one block is split once more, by what its sets
   share beyond what most of them have. The core are the tokens of over half of them. Sets that link share so
   many tokens that some are outside the core, unless the core is nearly all of both; how many at least
   follows from a set's size, its core and the largest share that the core has of any set. So
   prefixes of the tokens outside the core, rarest in the cluster first, are indexed, and only sets
   that meet there are compared; sets of which the core is too much (their links need no other
   token) are compared among themselves.

Components of the links give each document's component_id. doc_id must be a whole number (of any
width); another type raises. Texts that are null or without words have an empty set and link with
nothing. Rows with a null doc_id have a null component_id and link with nothing; rows that repeat a
doc_id each get their own set's component. Texts of any length are read whole. An empty table gives
an empty result. Columns beyond doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyring.llm import scratch
from tallyring.llm.components import components, stars, tasks_of
from tallyring.llm.text import GOLDEN, RADIX, SPACED, U64, Words, mix, sequences, slices

WORDS = 4
RARE = 32
#: Bits (4 MB) that tell frequent tokens by the end of their hash.
FREQUENT_BITS = 1 << 25
PART, BLOCK, BLOCK_BYTES = 128, 128, 8 << 20
#: Bytes of text whose words are hashed at once.
SLICE = 1 << 20
#: Bits (2 MB) of the filter by which documents outside all clusters stay where they are.
FILTER_BITS = 1 << 24


def least(n: int) -> int:
    """Tokens that a set of n shares with any similar set at least."""
    return -(-85 * n // 100)


def prefix(n: int) -> tuple[int, int]:
    """p and e of a set of n."""
    p = n - least(n) + 1
    return p, (p + 1) // 2


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted set of every text."""
    words = Words(data, at, SPACED)
    hashes = words.hash
    runs = sequences(hashes, WORDS)
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= WORDS:
            out.append(np.unique(runs[lo : hi - WORDS + 1]))
        else:
            out.append(sequences(hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, dtype=U64))
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(low: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches, "text", SLICE):
            sets = shingle_sets(data, at)
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary())]
            if low:
                columns.append(pa.array([s[: sum(prefix(len(s)))].tobytes() for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", *(["low"] if low else [])])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        joined = np.frombuffer(b"".join(batch.column("low").to_pylist()), dtype=np.int64)
        for lo in range(0, len(joined), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(joined[lo : lo + 500_000])], names=["token"])


def _whole_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, at in slices(batches, "text", SLICE):
        for tokens in shingle_sets(data, at):
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])


def _bits(places: DataFrame, size: int) -> np.ndarray:
    """A bit map of a column ``place`` (0 to size - 1), as bytes: size / 64 rows at most come here."""
    words = places.select(F.shiftright("place", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def _held(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7)) & 1 == 1


def _frequent(tokens: DataFrame):
    """Broadcast bit map of the tokens that stand more than RARE times."""
    common = tokens.groupBy("token").count().where(F.col("count") > RARE)
    bits = _bits(common.select(F.col("token").bitwiseAND(F.lit(FREQUENT_BITS - 1)).alias("place")), FREQUENT_BITS)
    return tokens.sparkSession.sparkContext.broadcast(bits)


def _common(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which tokens are frequent."""
    return _held(bits, (tokens & U64(FREQUENT_BITS - 1)).astype(np.int64))


def _least_e(n: int) -> int:
    """e of the smallest set similar to one of n."""
    return prefix(least(n))[1]


def _again(frequent):
    """Prefixes of whole sets, rare tokens first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches, "text", SLICE):
            sets = shingle_sets(data, at)
            low = []
            for s in sets:
                common = _common(frequent.value, s)
                low.append(np.concatenate([s[~common], s[common]])[: sum(prefix(len(s)))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(low, pa.binary())], names=["doc_id", "n", "low"])

    return run


def _posted(frequent):
    """Of every set, how many rare tokens are indexed, the last (its order as a signed number), and
    whether it has too many frequent tokens to be settled by rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, last, more = [], [], []
            for n, low in zip(batch.column("n").to_pylist(), batch.column("low").to_pylist(), strict=True):
                tokens = np.frombuffer(low, dtype=U64)
                common = _common(frequent.value, tokens)
                own = tokens[~common][: prefix(n)[0]]
                many.append(len(own))
                last.append(int(own[-1]) - (1 << 63) if len(own) else -(1 << 63))
                more.append(int(common.sum()) > _least_e(n))
            columns = [batch.column("doc_id"), pa.array(many, pa.int64()), pa.array(last, pa.int64()), pa.array(more, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "k", "last", "more"])

    return run


def _singles(frequent):
    """Index entries of rare tokens: key, doc, n and the token's rank among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, sizes, ranks = [], [], [], []
            for doc, n, low in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("low").to_pylist(), strict=True):
                tokens = np.frombuffer(low, dtype=U64)
                own = tokens[~_common(frequent.value, tokens)][: prefix(n)[0]]
                keys.append(own)
                docs.append(np.full(len(own), doc, dtype=np.int64))
                sizes.append(np.full(len(own), n, dtype=np.int64))
                ranks.append(np.arange(len(own), dtype=np.int32))
                if sum(map(len, keys[-500:])) > 500_000 or len(keys) >= 2000:
                    yield _entries(keys, docs, sizes, ranks)
                    keys, docs, sizes, ranks = [], [], [], []
            if keys:
                yield _entries(keys, docs, sizes, ranks)

    return run


def _entries(keys, docs, sizes, ranks) -> pa.RecordBatch:
    arrays = [np.concatenate(keys).view(np.int64), np.concatenate(docs), np.concatenate(sizes), np.concatenate(ranks)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["key", "doc", "n", "rank"])


def _combined(frequent):
    """Index entries of combinations, of sets that their rare tokens do not settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, n, low in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("low").to_pylist(), strict=True):
                tokens = np.frombuffer(low, dtype=U64)
                common = _common(frequent.value, tokens)
                if int(common.sum()) > _least_e(n):
                    keys = _combinations(tokens[common], n).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), doc, dtype=np.int64))], names=["key", "doc"])

    return run


def _level(n: int) -> int:
    """Levels of sizes: sets of like size are in one level or in two that follow each other."""
    level, size = 0, 1
    while size < n:
        level, size = level + 1, size * 100 // 85 + 1
    return level


def _smallest(level: int) -> int:
    """The smallest size in a level."""
    before, size = 0, 1
    for _ in range(level):
        before, size = size, size * 100 // 85 + 1
    return before + 1


def _combinations(tokens: np.ndarray, n: int) -> np.ndarray:
    """Keys of all pairs of tokens in the same of g classes, for the set's own level and the next."""
    out = []
    for level in (_level(n), _level(n) + 1):
        g = 1 << (max(1, prefix(_smallest(max(0, level - 1)))[1]).bit_length() - 1)
        kind = mix(tokens * U64(GOLDEN) + U64(g)) % U64(g)
        for c in range(g):
            own = tokens[kind == c]
            i, j = np.triu_indices(len(own), 1)
            out.append(mix(mix(own[i] + U64(level)) * U64(RADIX) + own[j]))
    return np.unique(np.concatenate(out))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that share a rare token, sizes allowing."""
    for batch in batches:
        column = batch.column("sets")
        begin = column.offsets.to_numpy()
        values = column.values
        doc, n, rank = (values.field(i).to_numpy() for i in range(3))
        length = np.diff(begin)
        for size in np.unique(length).tolist():
            i, j = np.triu_indices(size, 1)
            starts = begin[:-1][length == size]
            step = max(1, 400_000 // len(i))
            for lo in range(0, len(starts), step):
                x = (starts[lo : lo + step, None] + i).ravel()
                y = (starts[lo : lo + step, None] + j).ravel()
                close = 100 * np.minimum(n[x], n[y]) >= 85 * np.maximum(n[x], n[y])
                x, y = x[close], y[close]
                x, y = np.where(doc[x] < doc[y], x, y), np.where(doc[x] < doc[y], y, x)
                columns = [doc[x], doc[y], n[x], n[y], rank[x], rank[y]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "na", "nb", "ra", "rb"])


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def links(sets: list[np.ndarray], sides: list[int] | None = None, joined: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the sets to their components; with ``sides``, only pairs of unlike
    sides count (0 and 1); with ``joined``, no pairs of two such sets."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    tokens, token, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    lists, begin = owner[order], np.cumsum(many) - many
    at = np.cumsum(size) - size
    forest, out = _Forest(len(sets)), []
    side = np.array(sides) if sides is not None else None
    done = np.array(joined) if joined is not None else np.zeros(len(sets), dtype=bool)
    for i in range(len(sets)):
        own = token[at[i] : at[i] + size[i]]
        own = own[many[own] > 1]
        if not len(own):
            continue
        length = many[own]
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin[own], length)
        shared = np.bincount(lists[inside], minlength=len(sets))
        near = 185 * shared >= 85 * (size + size[i])
        near[: i + 1] = False
        if side is not None:
            near &= side != side[i]
        if done[i]:
            near &= ~done
        for j in np.flatnonzero(near).tolist():
            if forest.join(i, j):
                out.append((i, j))
    return out


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], key: int) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Rows (and sets) of groups that stand together, told by the first ``key`` columns."""
    rows, sets = [], []
    for batch, data, at in slices(batches, "text", SLICE):
        own = shingle_sets(data, at)
        for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)):
            if rows and row[:key] != rows[-1][:key]:
                yield rows, sets
                rows, sets = [], []
            rows.append(row)
            sets.append(own[k])
    if rows:
        yield rows, sets


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets against the smallest of their cluster, which stands first in each part: whether they
    link, and how far they are."""
    for rows, sets in _groups(batches, ("cluster", "part", "doc_id"), 2):
        first, out = sets[0], []
        for row, own in zip(rows, sets, strict=True):
            if row[2] == row[0]:
                continue
            place = np.minimum(np.searchsorted(first, own), len(first) - 1)
            at = int((first[place] == own).sum()) if len(first) else 0
            union = len(first) + len(own) - at
            out.append((row[0], row[2], 100 * at >= 85 * union, 1 - at / union))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.float64()), strict=True)], names=["cluster", "doc_id", "linked", "far"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the groups of rows that stand together by (cluster, b1, b2)."""
    for rows, sets in _groups(batches, ("cluster", "b1", "b2", "doc_id", "side", "linked"), 3):
        found = links(sets, [r[4] for r in rows] if rows[0][1] != rows[0][2] else None, [r[5] for r in rows])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([rows[j][3] for _, j in found], pa.int64()), pa.array([rows[i][3] for i, _ in found], pa.int64())], names=["u", "v"])


def classes(docs: DataFrame) -> DataFrame:
    """digest, doc_id (the smallest), n and low (the extended prefix) of every class."""
    rows = docs.where(F.col("doc_id").isNotNull()).mapInArrow(_sets(True), "doc_id long, n long, digest binary, low binary").where("n > 0")
    return scratch.table(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("low").alias("low")), "classes")


def _near(slim: DataFrame, frequent, posted: DataFrame) -> DataFrame:
    """u, v: pairs of sets that share an indexed rare token and may be similar."""
    single = slim.mapInArrow(_singles(frequent), "key long, doc long, n long, rank int")
    shared = single.groupBy("key").agg(F.collect_list(F.struct("doc", "n", "rank")).alias("sets")).where(F.size("sets") > 1)
    pairs = shared.select("sets").mapInArrow(_pairs, "a long, b long, na long, nb long, ra int, rb int")
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("ra").alias("ra"), F.max("rb").alias("rb"))
    # of the rare tokens up to the last shared one, those not shared are in one of the sets alone
    need = F.ceil(85 * (F.col("na") + F.col("nb")) / F.lit(185.0) - 1e-9)
    possible = (F.col("na") - (F.col("ra") + 1 - F.col("c")) >= need) & (F.col("nb") - (F.col("rb") + 1 - F.col("c")) >= need)
    # and of the set whose index entries end first, all those not shared
    for x in ("a", "b"):
        met = (met.where(possible) if x == "a" else met).join(posted.select(F.col("doc").alias(x), F.col("k").alias(f"k{x}"), F.col("last").alias(f"last_{x}")), x)
    ends = (F.when(F.col("last_a") <= F.col("last_b"), F.col("ka") - F.col("c") <= F.col("na") - need).otherwise(True)) & (F.when(F.col("last_b") <= F.col("last_a"), F.col("kb") - F.col("c") <= F.col("nb") - need).otherwise(True))
    return met.where(ends).select(F.col("b").alias("u"), F.col("a").alias("v"))


def candidates(docs: DataFrame, spoken: DataFrame) -> DataFrame:
    """u, v: pairs that join all sets that may be similar to clusters."""
    slim = spoken.select("doc_id", "n", "low")
    frequent = _frequent(slim.select("low").mapInArrow(_tokens, "token long"))
    posted = scratch.table(slim.mapInArrow(_posted(frequent), "doc long, k long, last long, more boolean"), "posted")
    near = _near(slim, frequent, posted)

    unsettled = posted.where("more").select(F.col("doc").alias("doc_id"))
    texts = scratch.table(docs.where(F.col("doc_id").isNotNull()).where(_likely(unsettled)).join(unsettled, "doc_id", "left_semi"), "unsettled")
    common = _frequent(texts.mapInArrow(_whole_tokens, "token long"))
    again = scratch.table(texts.select("doc_id", "text").mapInArrow(_again(common), "doc_id long, n long, low binary"), "again")
    posted_again = scratch.table(again.mapInArrow(_posted(common), "doc long, k long, last long, more boolean"), "posted")
    near = near.unionByName(_near(again, common, posted_again))
    combined = scratch.table(again.mapInArrow(_combined(common), "key long, doc long"), "combinations")
    first = combined.groupBy("key").agg(F.min("doc").alias("v"), F.count("*").alias("c")).where("c > 1").select("key", "v")
    met = combined.join(first, "key").where("doc <> v").select(F.col("doc").alias("u"), "v")
    out = scratch.table(stars(near.unionByName(met)), "candidates")
    for t in (posted, texts, again, posted_again, combined):
        scratch.drop(t)
    return out


def _likely(ids: DataFrame):
    """A predicate on doc_id that holds for all of ``ids`` (doc_id), and for few others while there
    are fewer ids than bits; past that it lets more through, and nothing is lost."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    shared = ids.sparkSession.sparkContext.broadcast(_bits(ids.select(place.alias("place")), FILTER_BITS))

    @F.pandas_udf("boolean")
    def held(place: pd.Series) -> pd.Series:
        return pd.Series(_held(shared.value, place.to_numpy()))

    return held(place)


def _dealt(rows: DataFrame, size: int, tasks: int) -> DataFrame:
    """Rows of clusters with the number of parts of about ``size`` rows or BLOCK_BYTES of text, and
    their own. As the numbers are written first, by ``tasks`` tasks at most, rows stay where they are if
    these are few, or else a large cluster is split."""
    parts = F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES), F.lit(1)).cast("int")
    parts = scratch.table(rows.groupBy("cluster").agg(parts.alias("parts")).coalesce(tasks), "parts")
    return rows.join(parts, "cluster").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))


def _token_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, at in slices(batches, "text", SLICE):
        sets = shingle_sets(data, at)
        size = np.array([len(x) for x in sets], dtype=np.int64)
        flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("doc_id"), pa.array(size), lists], names=["cluster", "doc_id", "n", "tokens"])


def split(rest: DataFrame) -> DataFrame:
    """Rows (cluster, doc_id, linked, text) of large clusters with smaller ones in their place; sets
    that can link with no other of their cluster are gone."""
    sets = scratch.table(rest.select("cluster", "doc_id", "text").mapInArrow(_token_lists, "cluster long, doc_id long, n long, tokens array<long>"), "tokens")
    rows = sets.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "cluster", "doc_id", "n", F.explode("tokens").alias("token"))
    members = sets.groupBy("cluster").agg(F.count("*").alias("members"))
    shared = each.groupBy("cluster", "token").agg(F.count("*").alias("sets")).where("sets > 1").join(members, "cluster")
    shared = scratch.table(shared.select("cluster", "token", "sets", (2 * F.col("sets") > F.col("members")).alias("core")), "shared")
    outside = F.sort_array(F.collect_list(F.when(~F.col("core"), F.struct("sets", "token"))))
    own = scratch.table(each.join(shared, ["cluster", "token"]).groupBy("row", "cluster", "doc_id", "n").agg(F.count_if("core").alias("c"), outside.alias("outside")), "outside")
    most = own.groupBy("cluster").agg(F.max(F.col("c") / F.col("n")).alias("most"))
    # of a partner of m tokens, at most the least of c and most * m are of the core: the number needed
    # outside of it is least where these meet, or at the end of the sizes that may link
    m = F.greatest(F.least(F.col("c") / F.col("most"), F.col("n") / 0.85), F.col("n") * 0.85)
    need = F.ceil(85 * (F.col("n") + m) / 185.0 - F.least(F.col("c"), F.col("most") * m) - 1e-6)
    told = own.join(most, "cluster").withColumn("need", F.when(F.col("most") > 0, need).otherwise(1))
    places = F.greatest(F.size("outside") - F.greatest(F.col("need"), F.lit(1)) + 1, F.lit(0)).cast("int")
    entries = told.select("cluster", "doc_id", F.explode(F.slice("outside", F.lit(1), places)).alias("x")).select("cluster", F.col("x.token").alias("key"), "doc_id")
    dense = told.where("need < 1").select("cluster", F.lit(None).cast("long").alias("key"), "doc_id")
    keyed = entries.unionByName(dense)
    first = keyed.groupBy("cluster", "key").agg(F.min("doc_id").alias("v"), F.count("*").alias("met")).where("met > 1")
    met = keyed.withColumnsRenamed({"cluster": "of", "key": "at"}).join(first, (F.col("of") == F.col("cluster")) & F.col("at").eqNullSafe(F.col("key")))
    edges = scratch.table(stars(met.where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")), "edges")
    parts = components(edges)
    out = rest.drop("cluster").join(parts.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    for t in (sets, shared, own, edges):
        scratch.drop(t)
    return out


def blocks(texts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows (cluster, doc_id, linked, text) as often as blocks of their cluster meet: b1, b2, side."""
    tasks = tasks or tasks_of(texts.count())
    rest = _dealt(texts.select("cluster", "doc_id", "linked", "text"), BLOCK, tasks)
    large = scratch.table(rest.where("parts > 1").select("cluster", "doc_id", "linked", "text"), "large")
    small = rest.where("parts = 1")
    if not large.isEmpty():
        small = small.unionByName(_dealt(split(large), BLOCK, tasks).select(*small.columns))
    sent = small.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return sent.select("cluster", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "doc_id", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "linked", "text")


def verified(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """u, v: true links that join each component, from clusters (node, component)."""
    named = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    near = docs.where(F.col("doc_id").isNotNull()).where(_likely(named))
    texts = scratch.table(near.join(named, "doc_id"), "texts")
    # the smallest set of a cluster goes to each of its parts
    tasks = tasks_of(texts.count())
    dealt = _dealt(texts, PART, tasks)
    first = F.col("doc_id") == F.col("cluster")
    sent = dealt.withColumn("part", F.explode(F.when(first, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own")))).withColumn("order", (~first).cast("int"))
    together = sent.select("cluster", "part", "order", "doc_id", "text").repartition("cluster", "part").sortWithinPartitions("cluster", "part", "order", "doc_id")
    told = scratch.table(together.mapInArrow(_against, "cluster long, doc_id long, linked boolean, far double"), "against")
    # a linked set can be near one left over only if their distances from the first differ by 0.15 at most
    left = told.where(~F.col("linked")).groupBy("cluster").agg(F.min("far").alias("nearest"))
    open_ = told.join(left, "cluster").where(~F.col("linked") | (F.col("far") >= F.col("nearest") - 0.15 - 1e-9)).select("cluster", "doc_id", "linked")
    sent = blocks(texts.join(open_, ["cluster", "doc_id"]), tasks)
    pairs = sent.repartition("cluster", "b1", "b2").sortWithinPartitions("cluster", "b1", "b2", "doc_id").mapInArrow(_verify, "u long, v long")
    out = scratch.table(pairs.unionByName(told.where("linked").select(F.col("doc_id").alias("u"), F.col("cluster").alias("v"))), "links")
    scratch.drop(texts)
    scratch.drop(told)
    return out


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes, and node, component of those that link with another."""
    if not isinstance(docs.schema["doc_id"].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        raise ValueError("doc_id must be a whole number")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spoken = classes(named)
    pairs = candidates(named, spoken)
    clusters = components(pairs)
    scratch.drop(pairs)
    found = verified(named, clusters)
    scratch.drop(clusters)
    linked = components(found)
    scratch.drop(found)
    return spoken, linked


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spoken, linked = groups(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", "text").mapInArrow(_sets(False), f"doc_id {kind}, n long, digest binary")
    by_class = spoken.select("digest", F.col("doc_id").alias("node")).join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    found = own.join(by_class, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with its component's id; columns as they came.

    Rows with a null doc_id stay. Rows that repeat a doc_id are judged together, and of those
    with the same text one stays."""
    kept, again = f"kept_{uuid.uuid4().hex}", f"again_{uuid.uuid4().hex}"
    one = join(docs).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    out = docs.join(one, docs["doc_id"].eqNullSafe(one[kept]), "left_semi")
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(again)).count().where("count > 1").select(again)
    if repeated.isEmpty():
        return out
    is_again = out["doc_id"] == repeated[again]
    return out.join(repeated, is_again, "left_anti").unionByName(out.join(repeated, is_again, "left_semi").dropDuplicates(["doc_id", "text"]))
