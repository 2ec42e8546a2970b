"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary's matches in a word; dynamic programming carries the
best score and its number of pieces, with the tie rules of the tokenizers library's Unigram
model over words split at white space, START before each. No ids or pieces are made; words
are counted once and kept in a cache of bounded bytes that is emptied when a task ends. No
shuffle.

Null or empty texts have no words and no tokens. Every input row gives one row, repeated rows
too. Texts and words of any length are counted whole. An empty table gives an empty result;
columns beyond doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyring.llm import unigram

_KEPT: dict[str, unigram.Counter] = {}


def _counter(path: str) -> unigram.Counter:
    if path not in _KEPT:
        _KEPT[path] = unigram.Counter(unigram.pieces(path))
    return _KEPT[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        kept = counter.kept.get
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column("text").to_pylist():
                words = counter.words(text or "")
                found = list(map(kept, words))
                if None in found:
                    found = [counter.word(w) if n is None else n for w, n in zip(words, found, strict=True)]
                n_words.append(len(words))
                n_tokens.append(sum(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])
        counter.forget()

    return run


def count(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_count(path), f"doc_id {kind}, n_words long, n_tokens long")
