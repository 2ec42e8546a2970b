"""Benchmark decontamination by an FM-index over each shard of training text.

A shard is some 2 MB of documents. Its words become symbols of the benchmark's
vocabulary; words outside it can be in no window, so only runs of vocabulary words as long
as the shortest window stay, with a separator between (whole documents are read for that;
nothing that could match is left out). Over these symbols the shard builds a suffix array,
its Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled at every
eighth symbol. All windows are searched backwards at once, a symbol a step, by ranks in
the wavelet matrix; occurrences are located by walking back to sampled positions, and the
spans of a document are merged. A shard is indexed once, however large the benchmark.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Windows: 13
consecutive words of an item; an item of fewer words, but not none, is one window. Words
are compared by 64-bit hashes.

The benchmark is a stated query set. It is split into blocks of at most ``BLOCK`` characters
(a single longer item is a block), which are broadcast one by one; the driver holds one at a time,
and so does a task, which takes them in turn from its executor's disk and searches each in its
shard's index. What all blocks share is their vocabulary (8 bytes a distinct word). Documents are
read once, are written nowhere and never move between tasks.

Null or empty texts have no words, no spans and no items. Items without words match
nothing; items with a null id count as the empty id, and items that share an id as one.
Every input row gives one output row, repeated rows too; texts of any length are read whole. A
name that is taken already raises in ``find``; ``report`` and ``clean`` take any columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyring.llm.text import ALNUM, Words, buffers, release

WINDOW = 13
BLOCK = 2 << 20
SHARD = 2 << 20
SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling."""
    n = len(s)
    rank, k = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class WaveletMatrix:
    """``rank(c, i)``: how often symbol c stands in the first i places, for arrays of c and i."""

    def __init__(self, s: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            b = (s >> level) & 1
            count = np.zeros(len(s) + 1, dtype=np.int32)
            np.cumsum(b, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(s) - int(count[-1]))
            s = np.concatenate([s[b == 0], s[b == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            i = np.where(bit, zeros + ones[i], i - ones[i])
        return i - lo


class FMIndex:
    """Over symbols from 1 on; 0 is the end."""

    def __init__(self, s: np.ndarray, symbols: int) -> None:
        s = np.append(s, 0)
        self.n = len(s)
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.tree = WaveletMatrix(self.bwt, max(1, int(symbols).bit_length()))
        self.before = np.zeros(symbols + 2, dtype=np.int64)
        np.cumsum(np.bincount(s, minlength=symbols + 1), out=self.before[1:])
        self.sampled = np.where(order % SAMPLE == 0, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of ``patterns``."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            lo[alive] = self.before[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.tree.rank(c, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
            if not len(alive):
                break
        gone = hi <= lo
        lo[gone] = hi[gone] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by their place in order."""
        out = np.full(len(rows), -1, dtype=np.int64)
        open_, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(open_):
            at = self.sampled[rows[open_]]
            found = at >= 0
            out[open_[found]] = at[found] + steps
            open_ = open_[~found]
            c = self.bwt[rows[open_]]
            rows[open_] = self.before[c] + self.tree.rank(c, rows[open_])
            steps += 1
        return out


class Block:
    """Windows of a part of the benchmark as symbols of a vocabulary: ``patterns`` by length, and the
    items of each pattern: ``items[size][begin[size][p] : begin[size][p + 1]]``."""

    def __init__(self, ids: list[str | None], texts: list[str | None], vocabulary: np.ndarray | None = None) -> None:
        words = Words(*buffers(pa.array(texts, pa.string())), ALNUM)
        own = vocabulary_of(texts) if vocabulary is None else vocabulary
        symbol = np.searchsorted(own, words.hash).astype(np.int32) + 2
        self.ids = sorted({i or "" for i in ids})
        place = {i: k for k, i in enumerate(self.ids)}
        item = np.array([place[i or ""] for i in ids], dtype=np.int32)
        size_of = np.minimum(words.count, WINDOW)
        self.patterns, self.items, self.begin = {}, {}, {}
        for size in sorted({*size_of.tolist()} - {0}):
            rows = np.flatnonzero(size_of == size)
            many = words.count[rows] - size + 1
            first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(words.first[rows], many)
            windows = symbol[first[:, None] + np.arange(size)]
            distinct, which = np.unique(windows, axis=0, return_inverse=True)
            pairs = np.unique(which.ravel().astype(np.int64) * len(self.ids) + item[np.repeat(rows, many)])
            self.patterns[size], self.items[size] = distinct, (pairs % len(self.ids)).astype(np.int32)
            self.begin[size] = np.searchsorted(pairs // len(self.ids), np.arange(len(distinct) + 1))
        self.shortest = min(self.patterns, default=0)

    def occurrences(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of all windows: first word, number of words, and (row, item) pairs once each."""
        words, index = shard.words, shard.index
        first, size, rows, items = ([np.zeros(0, dtype=np.int64)] for _ in range(4))
        for n, patterns in self.patterns.items() if index is not None else ():
            lo, hi = index.search(patterns)
            many = hi - lo
            which = np.repeat(np.arange(len(patterns)), many)
            places = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            where = shard.position[index.locate(places)]
            first.append(where)
            size.append(np.full(len(where), n))
            row = words.doc[where]
            pair = np.unique(which * len(words.first) + row)
            begin, end = self.begin[n][pair // len(words.first)], self.begin[n][pair // len(words.first) + 1]
            own = end - begin
            rows.append(np.repeat(pair % len(words.first), own))
            items.append(self.items[n][np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin, own)])
        pairs = np.unique(np.concatenate(rows) * max(1, len(self.ids)) + np.concatenate(items))
        return np.concatenate(first), np.concatenate(size), pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))


def vocabulary_of(texts: list[str | None]) -> np.ndarray:
    """Sorted hashes of the words of some texts."""
    return np.unique(Words(*buffers(pa.array(texts, pa.string())), ALNUM).hash)


class Shard:
    """Words of a shard and the index over its runs of vocabulary words that a window could lie in:
    ``position`` is the word of each symbol, -1 for separators."""

    def __init__(self, data: np.ndarray, at: np.ndarray, vocabulary: np.ndarray, shortest: int) -> None:
        self.words, self.index = Words(data, at, ALNUM), None
        words = self.words
        if not shortest or not len(words.start):
            return
        hashes = words.hash
        at = np.searchsorted(vocabulary, hashes)
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == hashes
        opens = known.copy()
        opens[1:] &= ~known[:-1] | (words.doc[1:] != words.doc[:-1])
        start = np.flatnonzero(opens)
        closes = known.copy()
        closes[:-1] &= ~known[1:] | (words.doc[1:] != words.doc[:-1])
        length = np.flatnonzero(closes) + 1 - start
        start, length = start[length >= shortest], length[length >= shortest]
        if not len(start):
            return
        to = np.cumsum(length + 1)
        self.position = np.full(to[-1], -1, dtype=np.int64)
        inside = np.ones(to[-1], dtype=bool)
        inside[to - 1] = False
        self.position[inside] = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
        s = np.ones(to[-1], dtype=np.int64)
        s[inside] = at[self.position[inside]] + 2
        self.index = FMIndex(s, len(vocabulary) + 1)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("first_word", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])
_FOUND_SQL = "struct<n_words:long,spans:array<struct<start:long,end:long,words:long,first_word:long>>,items:array<string>>"


def _in_turn(blocks: list) -> Iterator[Block]:
    """Broadcast blocks one after the other; of several, none stays in the worker's memory."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            del b._value  # read again from the executor's disk when it is asked for


def _shard(shared, blocks: list, data: np.ndarray, at: np.ndarray) -> pa.StructArray:
    """What all blocks find in a shard."""
    shard, n = Shard(data, at, *shared.value), len(at) - 1
    words = shard.words
    change = np.zeros(len(words.start) + 1, dtype=np.int64)
    names: list[set[str]] = [set() for _ in range(n)]
    for b in _in_turn(blocks) if shard.index is not None else ():
        where, size, rows, items = b.occurrences(shard)
        change += np.bincount(where, minlength=len(change)) - np.bincount(where + size, minlength=len(change))
        for r, i in zip(rows.tolist(), items.tolist(), strict=True):
            names[r].add(b.ids[i])
    hit = np.cumsum(change[:-1]) > 0
    opens = hit.copy()
    opens[1:] &= ~hit[:-1] | (words.doc[1:] != words.doc[:-1])
    closes = hit.copy()
    closes[:-1] &= ~hit[1:] | (words.doc[1:] != words.doc[:-1])
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes)
    spans: list[list[dict]] = [[] for _ in range(n)]
    if len(lo):
        points = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        doc = words.doc[lo]
        begin = points[words.start[lo]] - points[at[doc]]
        end = points[words.end[hi]] - points[at[doc]]
        for r, x, y, k, w in zip(doc.tolist(), begin.tolist(), end.tolist(), (hi + 1 - lo).tolist(), (lo - words.first[doc]).tolist(), strict=True):
            spans[r].append({"start": x, "end": y, "words": k, "first_word": w})
    return pa.StructArray.from_arrays([pa.array(words.count, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array([sorted(x) for x in names], pa.list_(pa.string()))], fields=list(FOUND))


def _column(shared, blocks: list) -> Column:
    """What the blocks find in ``text``. Only texts pass to Python, and only findings back."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, at = buffers(texts)
            out, lo = [], 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SHARD, side="right")) - 1)
                out.append(_shard(shared, blocks, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
                lo = hi
            yield pa.concat_arrays(out) if out else pa.array([], FOUND)
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _FOUND_SQL)(F.col("text"))


def _parts(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """Ids and texts of the benchmark, a block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK))
    for k in range(n):
        own = (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()
        yield [r[0] for r in own], [r[1] for r in own]


def find(docs: DataFrame, benchmark: DataFrame, name: str = "found") -> DataFrame:
    """``docs`` with a struct ``name``: n_words, spans (merged spans of hit words: start and end in
    code points, words, first_word) and items (ids with occurring windows, sorted)."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {name} already")
    context = docs.sparkSession.sparkContext
    vocabulary = np.zeros(0, dtype=np.uint64)
    for _, texts in _parts(benchmark):
        vocabulary = np.union1d(vocabulary, vocabulary_of(texts))
    blocks, shortest = [], []
    for ids, texts in _parts(benchmark):
        block = Block(ids, texts, vocabulary)
        blocks.append(context.broadcast(block))
        shortest.append(block.shortest)
        del block
    shared = context.broadcast((vocabulary, min((k for k in shortest if k), default=0)))
    return docs.withColumn(name, _column(shared, blocks))


def n_hit(found: str) -> Column:
    """Hit words of a row of :func:`find`."""
    return F.aggregate(F.col(f"`{found}`.spans"), F.lit(0).cast("long"), lambda n, x: n + x["words"])


def is_contaminated(found: str) -> Column:
    """Whether a twentieth of the words at least, and one, are hit."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(f"`{found}`.n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    v = find(docs.select("doc_id", "text"), benchmark)
    joined = F.array_join(F.array_sort("found.items"), ",")
    return v.select("doc_id", F.col("found.n_words").alias("n_words"), n_hit("found").alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), is_contaminated("found").alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, columns as they came."""
    name = f"found_{uuid.uuid4().hex}"
    return find(docs, benchmark, name).where(~is_contaminated(name)).drop(name)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item_id, ws, least(13, len(ws)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM i)),
dw AS (
  SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n)),
o AS (SELECT doc_id, item_id, dw.n, k FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
