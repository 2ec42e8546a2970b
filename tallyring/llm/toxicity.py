"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text (A-Z lower-cased, white space made spaces, a space before and after) is the bag of the
character n-grams of 4 to 6 UTF-8 bytes that lie within a word and its two boundary spaces; a word of one
byte is an n-gram with its spaces. Of
each ``WINDOW`` words a word counts once, so a word said over and over decides no text. N-grams
are hashed to 2**18 rows of an embedding table; a bag's embeddings, with ``PAD`` neutral ones,
are averaged and a linear softmax gives the probability of label 1. Table and softmax start from
small random numbers and are trained together by stochastic gradient descent, without any other
source of weights. Misspelt words share most n-grams with what was seen, and so their vectors.

Training takes a bounded sample of labelled rows: of each label those with the smallest hash of
their ids, at most ``SAMPLE`` rows and ``SAMPLE_BYTES`` of text (one row at least). Rows the
caller holds out are never looked at. Labels, lang, source and doc_id are never inputs of a
score. With only one label present (or none) scores are the share of label 1 (0.0 without
labels). Labels other than 0 and 1, nulls included, are not used; of rows that repeat a doc_id,
the largest label and the largest text hold.

Null or empty texts have the empty bag, and so the score of the model's intercept alone, capped
at the share of label 1. Texts of any length are scored whole, in pieces of ``SLICE`` bytes of
several texts or one text at a time. Rows that repeat, and ties, are scored one by one. An input
column with the name of the score raises; all others pass as they are. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyring.llm.text import _BYTE, GOLDEN, U64, _powers, buffers, mix, release

GRAMS = (4, 5, 6)
#: A word of one byte and its spaces, which no longer n-gram holds.
SHORT = 3
BUCKETS_LOG2 = 18
DIM = 4
WINDOW = 20
#: Labelled rows of each label, and bytes of their texts, that training takes at most.
SAMPLE, SAMPLE_BYTES = 2500, 8 << 20
EPOCHS, BATCH, RATE = 20, 64, 10.0
THRESHOLD = 0.7
#: Neutral entries that every bag has besides its own, so a few n-grams alone decide little.
PAD = 1000
#: What the average is multiplied by before the softmax: an n-gram's share of a text is small.
GAIN = 100.0
#: Bytes of text that are cut into n-grams at once.
SLICE = 256 << 10
#: The largest count of an entry of a training text.
MOST = 65535
#: Where the threshold lies between what the sample's worst clean and mildest toxic texts score.
PLACE = 0.1


def _spaces() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[0x09:0x0E] = 0x20
    return t


_PLAIN = _spaces()


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and bucket of every n-gram of the bags of several texts, a length at a time."""
    docs = len(at) - 1
    text = np.full(len(data) + docs + 1, 0x20, dtype=np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(1, docs + 1), np.diff(at))] = _PLAIN[data]
    n = len(text)
    space = text == 0x20
    opens = ~space
    opens[1:] &= space[:-1]
    start = np.flatnonzero(opens)
    ends = np.flatnonzero(np.append(space, True)[1:] & ~space) + 1
    first = np.searchsorted(start, at + np.arange(docs + 1))
    owner = np.repeat(np.arange(docs), np.diff(first))
    window = (np.arange(len(start)) - np.repeat(first[:-1], np.diff(first))) // WINDOW
    blanks = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(space, out=blanks[1:])
    p, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[text] * p[:n], out=sums[1:])
    words = mix((sums[ends] - sums[start]) * inverse[start] + (owner.astype(U64) << U64(32) | window.astype(U64)) * U64(GOLDEN))
    new = np.zeros(len(start) + 1, dtype=bool)  # one more for what stands after the last word
    new[np.unique(words, return_index=True)[1]] = True
    # an n-gram that starts at the space before a word belongs to that word
    word_at = np.cumsum(opens)
    word = np.where(space, word_at, word_at - 1)
    fresh = new[word]
    for k in (SHORT, *GRAMS):
        if n >= k:
            inside = blanks[k - 1 : n] - blanks[1 : n - k + 2] == 0  # bytes 1 to k - 2 are no spaces
            if k == SHORT:
                inside &= space[: n - k + 1] & space[k - 1 :]
            i = np.flatnonzero(inside & fresh[: n - k + 1])
            h = (sums[i + k] - sums[i]) * inverse[i]
            yield owner[word[i]], (mix(h + U64(k)) >> U64(64 - BUCKETS_LOG2)).astype(np.int32)


def _cuts(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows lo to hi of about SLICE bytes, one at least."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, side="right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Model:
    """``weight`` per bucket: the difference of the two classes' logits; ``intercept``; ``prior``."""

    weight: np.ndarray
    intercept: float
    prior: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every text; the texts of a few hundred kilobytes at a time."""
        out = np.empty(len(at) - 1)
        for lo, hi in _cuts(at):
            n = hi - lo
            total, size = np.zeros(n), np.zeros(n)
            for own, bucket in grams(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]):
                total += np.bincount(own, weights=self.weight[bucket], minlength=n)
                size += np.bincount(own, minlength=n)
            score = 1 / (1 + np.exp(-np.clip(GAIN * total / (size + PAD) + self.intercept, -500, 500)))
            out[lo:hi] = np.where(size == 0, np.minimum(score, self.prior), score)
        return out


class Sample:
    """Bags of the training texts: distinct buckets of each text and how often they stand there."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        at = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        bucket, count, held, size = [], [], [], []
        for lo, hi in _cuts(at):
            own, of = map(np.concatenate, zip(*grams(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]), strict=True))
            key, many = np.unique(own.astype(np.int64) << BUCKETS_LOG2 | of, return_counts=True)
            # counts have 16 bits: one beyond that is several entries of the same bucket
            entries = 1 + (many - 1) // MOST
            last = np.cumsum(entries) - 1
            key, share = np.repeat(key, entries), np.full(int(entries.sum()), MOST)
            share[last] = many - (entries - 1) * MOST
            bucket.append((key & ((1 << BUCKETS_LOG2) - 1)).astype(np.int32))
            count.append(share.astype(np.uint16))
            held.append(np.bincount(key >> BUCKETS_LOG2, minlength=hi - lo))
            size.append(np.bincount(own, minlength=hi - lo))
        self.bucket = np.concatenate(bucket)
        bucket.clear()  # the largest of all arrays is not held twice
        self.count, self.held, self.size = map(np.concatenate, (count, held, size))
        self.start = np.cumsum(self.held) - self.held
        del raw, data
        release()

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of some texts, in their order, their shares of the average, and numbers of buckets."""
        held = self.held[texts]
        inside = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(self.start[texts], held)
        share = self.count[inside] * np.repeat(GAIN / (self.size[texts] + PAD), held)
        return self.bucket[inside], share.astype(np.float32), held


def _sums(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of the given lengths."""
    padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), dtype=values.dtype)])
    out = np.add.reduceat(padded, np.cumsum(held) - held, axis=0)
    out[held == 0] = 0
    return out


def train(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fit on whole texts with labels 0 and 1, which weigh the same in all."""
    prior = float(labels.mean()) if len(labels) else 0.0
    if len(set(labels.tolist())) < 2:
        flat = np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))
        return Model(np.zeros(1 << BUCKETS_LOG2, dtype=np.float32), float(flat), prior)
    random, sample, n = np.random.default_rng(seed), Sample(texts), len(texts)
    table = np.zeros((1 << BUCKETS_LOG2, DIM), dtype=np.float32)  # n-grams not seen stay neutral
    seen = np.zeros(1 << BUCKETS_LOG2, dtype=bool)
    seen[sample.bucket] = True
    table[seen] = random.normal(0, 0.01, (int(seen.sum()), DIM))
    soft, bias = random.normal(0, 1, (DIM, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    seen_soft, seen_bias = np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    weight = n * np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))
    steps = [part for _ in range(epochs) for part in np.array_split(random.permutation(n), -(-n // BATCH))]
    for step, own in enumerate(steps):
        bucket, share, held = sample.of(own)
        mean = _sums(table[bucket] * share[:, None], held)
        z = mean @ soft + bias
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(own)), labels[own]] -= 1
        q *= weight[own][:, None] / len(own)
        g_soft, g_bias, g_mean = mean.T @ q, q.sum(axis=0), q @ soft.T
        unique, inverse = np.unique(bucket, return_inverse=True)
        owner = np.repeat(np.arange(len(own)), held)
        g_table = np.stack([np.bincount(inverse, weights=share * g_mean[owner, d], minlength=len(unique)) for d in range(DIM)], axis=1)
        rate = 1 - step / len(steps)
        table[unique] -= (RATE * rate * g_table).astype(np.float32)
        seen_soft += g_soft**2
        seen_bias += g_bias**2
        soft -= (0.1 * rate * g_soft / np.sqrt(seen_soft)).astype(np.float32)
        bias -= (0.1 * rate * g_bias / np.sqrt(seen_bias)).astype(np.float32)
    model = Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), prior)
    clean, toxic = edges(model, sample, labels)
    del sample
    release()
    model.intercept += float(np.log(THRESHOLD / (1 - THRESHOLD)) - (clean + PLACE * max(0.1, toxic - clean)))
    return model


def edges(model: Model, sample: Sample, labels: np.ndarray) -> tuple[float, float]:
    """Logits of the sample's worst clean and its mildest toxic texts. The threshold lies between,
    nearer to the clean, as texts that training has seen score more surely than others."""
    logit = GAIN * _sums(model.weight[sample.bucket] * sample.count, sample.held) / (sample.size + PAD) + model.intercept
    return max(model.intercept, float(np.quantile(logit[labels == 0], 0.995))), float(np.quantile(logit[labels == 1], 0.02))


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the bounded sample. ``usable`` tells, of a doc_id, whether training may see it."""
    spark = docs.sparkSession
    own = labels.where(F.col("toxic").isin(0, 1) & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = F.xxhash64(F.col("doc_id").cast("string"))
    picked = [own.where(F.col("toxic") == y).orderBy(key, "doc_id").limit(sample).select("doc_id", "toxic") for y in (0, 1)]
    rows = [r for p in picked for r in p.collect()]  # 2 * sample rows at most, in order of hashes
    if not rows:
        return [], np.zeros(0, dtype=np.int64)

    def among(ids: list) -> DataFrame:
        known = spark.createDataFrame([(x,) for x in ids], picked[0].select("doc_id").schema)
        return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id")

    sizes = dict(among([r[0] for r in rows]).agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0)))).collect())
    taken, used = {}, {0: 0, 1: 0}
    for doc, label in rows:
        if doc in sizes and (not used[label] or used[label] + sizes[doc] <= most):
            used[label] += sizes[doc] + 1
            taken[doc] = label
    found = among(list(taken)).agg(F.max(F.coalesce("text", F.lit("")))).orderBy("doc_id").collect() if taken else []
    return [r[1] for r in found], np.array([taken[r[0]] for r in found], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    return train(*labelled(docs, labels, usable, sample))


def scorer(docs: DataFrame, model: Model) -> Column:
    """The score of ``text`` as a column. Only texts pass to Python, and only numbers back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.scores(*buffers(texts)), pa.float64())
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(F.col("text"))


def score(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """``docs`` with the score of its whole text."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {name} already")
    return docs.withColumn(name, scorer(docs, model))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows that score below the threshold, with the columns they came with."""
    return docs.where(scorer(docs, model) < threshold)
