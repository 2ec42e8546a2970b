"""Language-model scores by subword lattices.

A text is its words and one end. Its probability is that of all ways to write it in pieces of an
existing unigram vocabulary: pieces are drawn one after the other, each with the probability that
the vocabulary's own scores give it, until the end comes; a word begins with a piece that begins
with START. Words are summed over all their segmentations by forward recursion, and as no piece
reaches over two words, the text's probability is the product over its words, times the end.

What is learnt, from the training documents' whole text: the temperature that turns scores into
probabilities (the scores of a vocabulary made by merges are ranks, not logarithms), by the
likelihood of all training words at temperatures a ``FACTOR`` apart, which begin around the spread of
the scores and go on as far as it takes until the best lies inside, and the best point of a parabola
through it and its neighbours; and the chance of the end, from the expected number of pieces (the
slope of the likelihood where every piece is ``STEP`` less likely, at the best of them). So scores that
are logarithms are used as they are, if that is best.

That is :func:`score`, which knows nothing else of the training documents. :func:`learnt` adds what they
say, and is what the query returns:

* Pieces: the scores over the temperature are the prior, worth ``PRIOR`` pieces, of the weights that
  expectation maximisation over the training documents' distinct words gives the pieces, in each class of
  documents (a column, as their language, where there is one). A block runs its ``ROUNDS`` for itself; the
  expected uses of all blocks are summed.
* Words: a word of the training documents, and the end, has its count over N, less a part; this part (of
  words seen once in N, Good and Turing) goes to all other words, by their lattice.
* Classes: the lattices of all classes tell of each word how likely each class is, and a text is the
  sum over classes of the products over its words. Its own label is not read.

A word's probability in a class is the known word's times its chance of the class over the mean chance
of it in all training words, or the lattice's of the class: they sum to 1 at most.

How it runs. Documents are cut into blocks of about ``BLOCK`` bytes, a lattice is summed once for
each distinct word of a block, and documents add up their words'. A first pass sums, a block, the
likelihoods of its training words. A second one scores the documents, and writes, for the base,
each block's distinct words (hash and training count) and the places of each document's words in
that list; :func:`learnt` writes lattice sums of those words that no training document of the block has,
as only these can be unknown. Counts are summed by hash, counted within blocks first, so the commonest word is one row
a block; they go back to the blocks and meet the documents there. No text of a word is shuffled.
Only sums (one row a temperature, a class and piece) reach the driver.

Base (for comparison): sum over tokens of ``log10((c + 1) / (N + V + 1))``.

Null texts are empty: one end. Every row gives one row, repeated rows and ids too; a text of any
length is scored whole. Without training documents, N is 0, the first temperature and an
end after ``END`` pieces hold, in :func:`learnt` too. An empty table gives an empty result. Columns beyond doc_id, text and
those of ``held_out`` and the classes are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyring.llm import scratch, unigram
from tallyring.llm.text import LOWER, SPACED, Words, slices

BLOCK = 8 << 20
#: Between temperatures; of the first ones, over the deviation of the vocabulary's scores.
FACTOR, FIRST = 3.0, (1 / 15, 1 / 5, 3 / 5, 9 / 5)
#: Times that the temperatures are widened at most: 3^24 is more than any scores are apart, so a best
#: that is not inside by then is that of a likelihood that temperatures do not change.
WIDENED = 12
STEP = 1e-3
#: Pieces before the end, where no document tells.
END = 1000.0
#: Words whose lattices are summed together: enough of each length to work in whole arrays.
TOGETHER = 100_000
#: What the vocabulary's scores weigh beside the training words, in pieces, and rounds of learning.
PRIOR, ROUNDS = 1000.0, 3
#: Classes with most training documents that have pieces of their own; the others share.
CLASSES = 8


class Block:
    """Distinct words of some documents, those in training documents and the commonest first: ``hash``, ``counts`` in training documents, code
    points (lower-cased; word i from ``start[i]``, ``length[i]`` long), and ``places`` of every
    word of the documents among them."""

    def __init__(self, parts: list[tuple[pa.RecordBatch, Words]]) -> None:
        self.parts = parts
        words = pa.array(np.concatenate([w.hash for _, w in parts]).view(np.int64)).dictionary_encode()
        distinct, places = words.dictionary.to_numpy().view(np.uint64), words.indices.to_numpy()
        first = np.empty(len(distinct), dtype=np.int64)
        first[places[::-1]] = np.arange(len(places) - 1, -1, -1)
        trained = np.concatenate([np.repeat(~b.column("held_out").to_numpy(zero_copy_only=False), w.count) for b, w in parts])
        seen = np.bincount(places[trained], minlength=len(distinct)) > 0
        # the commonest first, so that most places are small numbers, which take little room
        order = np.lexsort((-np.bincount(places, minlength=len(distinct)), ~seen))
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.hash, first, self.places = distinct[order], first[order], rank[places]
        self.counts = np.bincount(self.places[trained], minlength=len(self.hash))
        before = np.cumsum([0, *[len(w.start) for _, w in parts]])
        part = np.searchsorted(before, first, side="right") - 1
        self.start, self.length = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
        codes, at = [], 0
        for k, (_, w) in enumerate(parts):
            own = np.flatnonzero(part == k)
            points, begin, end = _code_points(w, first[own] - before[k])
            self.start[own], self.length[own] = begin + at, end - begin
            codes.append(points)
            at += len(points)
        self.codes = np.concatenate(codes)

    def score(self, lattice: unigram.Lattice, words: np.ndarray, log_p: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of some words, a row for each of the weights."""
        out = np.empty((len(log_p), len(words)))
        for lo in range(0, len(words), TOGETHER):
            own = words[lo : lo + TOGETHER]
            out[:, lo : lo + TOGETHER] = lattice.score_codes(self.codes, self.start[own], self.length[own], log_p)
        return out

    def classes(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Classes of training documents, how many words they have, and which distinct ones."""
        of = np.concatenate([np.repeat(b.column("class").to_numpy(zero_copy_only=False), w.count) for b, w in self.parts])
        for k in np.unique(of).tolist():
            own, seen = self.places[of == k], np.zeros(len(self.hash), dtype=bool)
            seen[own] = True
            yield k, len(own), np.flatnonzero(seen)

    def documents(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows, the places of their words, and where each row's begin, one more than rows."""
        at = 0
        for batch, w in self.parts:
            yield batch, self.places[at : at + len(w.start)], w.first
            at += len(w.start)


def _code_points(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of some words, A-Z lower-cased, and where each begins and ends in them."""
    length = w.end[which] - w.start[which]
    to = np.cumsum(length)
    data = LOWER[w.data[np.arange(to[-1] if len(to) else 0) - np.repeat(to - length, length) + np.repeat(w.start[which], length)]]
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        counted = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    except UnicodeDecodeError:  # bytes that are no text stand for themselves
        points, counted = data.astype(np.uint32), np.arange(len(data) + 1)
    return points, counted[to - length], counted[to]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    parts, size = [], 0
    for batch, data, at in slices(batches, "text", 1 << 20):
        parts.append((batch, Words(data, at, SPACED)))
        size += len(data)
        if size >= BLOCK:
            yield Block(parts)
            parts, size = [], 0
    if parts:
        yield Block(parts)


_KEPT: dict[str, tuple[unigram.Lattice, np.ndarray]] = {}


def vocabulary(path: str) -> tuple[unigram.Lattice, np.ndarray]:
    """The lattice over a vocabulary's pieces, and their scores; unused pieces are left out."""
    if path not in _KEPT:
        found = [(p, s) for p, s in unigram.pieces(path) if s > -1e8]
        _KEPT[path] = unigram.Lattice([p for p, _ in found]), np.array([s for _, s in found])
    return _KEPT[path]


def first_temperatures(scores: np.ndarray) -> list[float]:
    spread = float(np.std(scores)) or 1.0
    return [spread * f for f in FIRST]


def _fit(path: str, temperatures: list[float], ends: tuple[float, ...] = (0.0, STEP)):
    """Of a task's training words, a row a temperature: sum of log probabilities, and of those with
    every piece a step less likely (or the same again, with but one of the ``ends``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, scores = vocabulary(path)
        n = len(temperatures)
        log_p = [unigram.weights(scores, t, end) for end in ends for t in temperatures]
        sums = np.zeros(len(log_p))
        for block in _blocks(batches):
            seen = np.flatnonzero(block.counts)
            sums += (block.score(lattice, seen, log_p) * block.counts[seen]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(sums[:n]), pa.array(sums[-n:])], names=["k", "log_p", "less"])

    return run


def fitted(scores: np.ndarray, measure) -> tuple[dict[float, tuple[float, float]], bool]:
    """Likelihoods by temperature, widened until the best is inside, and whether any word told.
    ``measure`` gives (log_p, less) of each of some temperatures."""
    now = first_temperatures(scores)
    found = dict(zip(now, measure(now), strict=True))
    for _ in range(WIDENED):
        at = sorted(found)
        values = [found[t][0] for t in at]
        top = int(np.argmax(values))
        if not any(values) or 0 < top < len(at) - 1:
            break
        now = [at[0] / FACTOR**2, at[0] / FACTOR] if top == 0 else [at[-1] * FACTOR, at[-1] * FACTOR**2]
        found |= dict(zip(now, measure(now), strict=True))
    return found, any(v[0] for v in found.values())


def best(found: dict[float, tuple[float, float]]) -> tuple[float, float]:
    """Temperature of the highest likelihood, by a parabola over log temperatures through the best of
    those measured and its neighbours, and the expected number of pieces at the best."""
    at = sorted(found)
    x, log_p = np.log(at), np.array([found[t][0] for t in at])
    top = int(np.argmax(log_p))
    k = int(np.clip(top, 1, len(at) - 2))
    a, b, _ = np.polyfit(x[k - 1 : k + 2], log_p[k - 1 : k + 2], 2)
    place = float(np.clip(-b / (2 * a), x[k - 1], x[k + 1])) if a < 0 else float(x[top])
    return float(np.exp(place)), float((found[at[top]][1] - log_p[top]) / np.log1p(-STEP))


def _cut(path: str, temperature: float, end: float):
    """Rows of two kinds: a block's words (h, i, c) and its documents (doc_id, held_out, score, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, scores = vocabulary(path)
        log_p = [unigram.weights(scores, temperature, end)]
        first = TaskContext.get().partitionId() << 24
        kinds = {"block": pa.int64(), "h": pa.int64(), "i": pa.int32(), "c": pa.int64(), "doc_id": None, "held_out": pa.bool_(), "score": pa.float64(), "ids": pa.binary()}

        def rows(n: int, given: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(given[c], kind) if c in given else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))

        for number, block in enumerate(_blocks(batches)):
            kinds["doc_id"] = block.parts[0][0].schema.field("doc_id").type
            of_words = block.score(lattice, np.arange(len(block.hash)), log_p)[0]
            for lo in range(0, len(block.hash), TOGETHER):
                to = min(lo + TOGETHER, len(block.hash))
                yield rows(to - lo, {"block": np.full(to - lo, first + number), "h": block.hash[lo:to].view(np.int64), "i": np.arange(lo, to), "c": block.counts[lo:to]})
            for batch, places, at in block.documents():
                ids = [places[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                found = np.array([of_words[places[a:b]].sum() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                yield rows(batch.num_rows, {"block": np.full(batch.num_rows, first + number), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": (found + np.log(end)) / np.log(10), "ids": ids})

    return run


def _learn(path: str, temperature: float):
    """Of a task's training words, a row a class and piece: the expected use of the piece in distinct words;
    a row a class with the piece -1 has the number of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, scores = vocabulary(path)
        prior = unigram.weights(scores, temperature)
        uses: dict[int, np.ndarray] = {}
        for block in _blocks(batches):
            for k, n, words in block.classes():
                found = lattice.uses(block.codes, block.start[words], block.length[words], lambda u: unigram.updated(u, prior, PRIOR), prior, ROUNDS)
                uses[k] = uses.get(k, 0) + np.append(found, n)
        for k, use in uses.items():
            own = np.flatnonzero(use)
            piece = np.where(own == len(prior), -1, own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k), pa.int32()), pa.array(piece, pa.int32()), pa.array(use[own])], names=["class", "piece", "use"])

    return run


def _cut_learnt(path: str, log_p: np.ndarray, share: np.ndarray):
    """Rows of three kinds: a block's words (h, i, c); its documents (doc_id, held_out, chance, ids), ``chance``
    the sums of the logs of each class's chance over the document's words; and one with ``spelled``, log
    probabilities of the last words, which no training document of the block has, and as ``chance``
    the sums of each class's chance over all training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, _ = vocabulary(path)
        first = TaskContext.get().partitionId() << 24
        kinds = {"block": pa.int64(), "h": pa.int64(), "i": pa.int32(), "c": pa.int64(), "doc_id": None, "held_out": pa.bool_(), "chance": pa.list_(pa.float64()), "ids": pa.binary(), "spelled": pa.binary()}

        def rows(n: int, given: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(given[c], kind) if c in given else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))

        for number, block in enumerate(_blocks(batches)):
            kinds["doc_id"] = block.parts[0][0].schema.field("doc_id").type
            chance = block.score(lattice, np.arange(len(block.hash)), list(log_p)) + np.log(share)[:, None]
            spelled = np.logaddexp.reduce(chance, axis=0)
            chance -= spelled
            for lo in range(0, len(block.hash), TOGETHER):
                to = min(lo + TOGETHER, len(block.hash))
                yield rows(to - lo, {"block": np.full(to - lo, first + number), "h": block.hash[lo:to].view(np.int64), "i": np.arange(lo, to), "c": block.counts[lo:to]})
            yield rows(1, {"block": [first + number], "chance": [(np.exp(chance) * block.counts).sum(axis=1)], "spelled": [spelled[np.count_nonzero(block.counts) :].tobytes()]})
            for batch, places, at in block.documents():
                bounds = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                ids = [places[a:b].astype("<i4").tobytes() for a, b in bounds]
                chances = [chance[:, places[a:b]].sum(axis=1) for a, b in bounds]
                yield rows(batch.num_rows, {"block": np.full(batch.num_rows, first + number), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "chance": chances, "ids": ids})

    return run


def base(c: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of the base probabilities of tokens seen c times."""
    return np.log10(c + 1.0) - np.log10(float(total + distinct + 1))


def _meet(ends: int, total: int, distinct: int):
    """Counts and base scores of a block's documents from its words."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        docs, words = docs.combine_chunks(), words.combine_chunks()
        c = np.zeros(words.num_rows, dtype=np.int64)
        c[words.column("i").to_numpy()] = words.column("c").to_numpy()
        of_base, of_end = base(c, total, distinct), base(np.array([ends]), total, distinct)[0]
        n_tokens, n_known, based = [], [], []
        for ids in docs.column("ids"):
            own = np.frombuffer(ids.as_buffer(), dtype="<i4")
            n_tokens.append(len(own) + 1)
            n_known.append(int((c[own] > 0).sum()) + (ends > 0))
            based.append(float(of_base[own].sum() + of_end))
        arrays = [docs.column("doc_id"), docs.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(docs.num_rows, total), pa.int64()), pa.array(based, pa.float64()), docs.column("score")]
        return pa.table(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _meet_learnt(ends: int, total: int, distinct: int, unseen: float, share: np.ndarray, mean: np.ndarray):
    """As :func:`_meet`, with scores: ``unseen`` is what all unknown words have together, ``share`` each
    class's part of the words, ``mean`` its mean chance over training words."""
    log_share, log_mean = np.log(share), np.log(mean)

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        docs, words = docs.combine_chunks(), words.combine_chunks()
        told = docs.column("spelled").is_valid()
        spelled = np.frombuffer(docs.filter(told).column("spelled")[0].as_buffer(), dtype=np.float64)
        docs = docs.filter(pc.invert(told)).combine_chunks()
        c = np.zeros(words.num_rows, dtype=np.int64)
        c[words.column("i").to_numpy()] = words.column("c").to_numpy()
        of_base, of_end = base(c, total, distinct), base(np.array([ends]), total, distinct)[0]
        of_word = np.log(np.maximum(c, 1)) + np.log1p(-unseen) - np.log(total)
        last = len(c) - len(spelled)
        of_word[last:] = np.where(c[last:] > 0, of_word[last:], np.log(unseen) + spelled)
        end = np.log(ends) + np.log1p(-unseen) - np.log(total)
        n_tokens, n_known, based, scored = [], [], [], []
        for ids, chance in zip(docs.column("ids"), docs.column("chance"), strict=True):
            own = np.frombuffer(ids.as_buffer(), dtype="<i4")
            known = int((c[own] > 0).sum())
            n_tokens.append(len(own) + 1)
            n_known.append(known + 1)
            based.append(float(of_base[own].sum() + of_end))
            of_class = log_mean + chance.values.to_numpy() - known * log_mean - (len(own) - known) * log_share
            scored.append(float(of_word[own].sum() + end + np.logaddexp.reduce(of_class)) / np.log(10))
        arrays = [docs.column("doc_id"), docs.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(docs.num_rows, total), pa.int64()), pa.array(based, pa.float64()), pa.array(scored, pa.float64())]
        return pa.table(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _measured(teaching: DataFrame, fit, n: int) -> list[tuple[float, float]]:
    """Sums of :func:`_fit` over all tasks."""
    sums = teaching.mapInArrow(fit, "k int, log_p double, less double").groupBy("k").agg(F.sum("log_p"), F.sum("less")).collect()
    by_place = {r[0]: (r[1], r[2]) for r in sums}
    return [by_place.get(i, (0.0, 0.0)) for i in range(n)]


def score(docs: DataFrame, held_out: Column, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document;
    documents where ``held_out`` is true teach nothing."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    ends = named.where(~F.col("held_out")).count()
    teaching = named.where(~F.col("held_out")).select("text", "held_out")

    scores = vocabulary(path)[1]
    found, told = fitted(scores, lambda temperatures: _measured(teaching, _fit(path, temperatures), len(temperatures)))
    temperature, pieces = best(found) if told else (first_temperatures(scores)[0], 0.0)
    end = ends / (ends + pieces) if ends and pieces else 1 / (1 + END)

    schema = f"block long, h long, i int, c long, doc_id {kind}, held_out boolean, score double, ids binary"
    cut = scratch.table(named.mapInArrow(_cut(path, temperature, end), schema), "blocks")
    words = cut.where(F.col("h").isNotNull()).select("block", "h", "i", "c")
    counted = words.groupBy("h").agg(F.sum("c").alias("c"))
    sums = counted.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, distinct = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    back = words.select("h", "block", "i").join(counted, "h").drop("h")
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    documents = cut.where(F.col("ids").isNotNull()).select(F.col("block").alias("of"), "doc_id", "held_out", "score", "ids")
    return documents.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(_meet(ends, total, distinct), out)


def learnt(docs: DataFrame, held_out: Column, path: str, classes: Column | None = None) -> DataFrame:
    """As :func:`score`, by the pieces, words and classes that the training documents teach. ``classes`` of
    training documents alone are read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    label = (F.lit(None) if classes is None else classes).cast("string")
    named = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), label.alias("label"))
    known = named.where(~F.col("held_out"))
    by_label = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ends = by_label.agg(F.sum("n")).first()[0] or 0
    if not ends:
        return score(docs, held_out, path)
    # in a row of the most frequent; null and all others are the last
    own = [r[0] for r in by_label.where(F.col("label").isNotNull()).orderBy(F.desc("n"), "label").limit(CLASSES).collect()]
    number = F.coalesce(F.array_position(F.array(*map(F.lit, own)), F.col("label")), F.lit(0)) if own else F.lit(0)
    teaching = known.select("text", "held_out", number.cast("int").alias("class"))

    scores = vocabulary(path)[1]
    found, told = fitted(scores, lambda ts: _measured(teaching.select("text", "held_out"), _fit(path, ts, (0.0,)), len(ts)))
    temperature = best(found)[0] if told else first_temperatures(scores)[0]
    prior = unigram.weights(scores, temperature)
    uses = np.zeros((len(own) + 1, len(prior) + 1))
    sums = teaching.mapInArrow(_learn(path, temperature), "class int, piece int, use double").groupBy("class", "piece").agg(F.sum("use").alias("use")).toArrow()
    uses[sums.column("class").to_numpy(), sums.column("piece").to_numpy()] = sums.column("use").to_numpy()
    uses = uses[uses[:, -1] > 0] if uses[:, -1].any() else uses[:1]
    share = (uses[:, -1] + 1) / (uses[:, -1] + 1).sum()
    log_p = np.array([unigram.updated(u[:-1], prior, PRIOR) for u in uses])

    schema = f"block long, h long, i int, c long, doc_id {kind}, held_out boolean, chance array<double>, ids binary, spelled binary"
    cut = scratch.table(named.select("doc_id", "text", "held_out").mapInArrow(_cut_learnt(path, log_p, share), schema), "blocks")
    words = cut.where(F.col("h").isNotNull()).select("block", "h", "i", "c")
    counted = words.groupBy("h").agg(F.sum("c").alias("c"))
    n, v, once = counted.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    total, distinct, unseen = (n or 0) + ends, (v or 0) + 1, ((once or 0) + 1) / ((n or 0) + ends + 2)
    chances = cut.where(F.col("spelled").isNotNull()).select(*[F.sum(F.col("chance")[k]).alias(f"c{k}") for k in range(len(share))]).first()
    mean = np.array([max(float(x or 0.0), 1e-300) for x in chances]) / n if n else share
    back = words.select("h", "block", "i").join(counted, "h").drop("h")
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    documents = cut.where(F.col("ids").isNotNull() | F.col("spelled").isNotNull()).select(F.col("block").alias("of"), "doc_id", "held_out", "chance", "ids", "spelled")
    return documents.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(_meet_learnt(ends, total, distinct, unseen, share, mean), out)
