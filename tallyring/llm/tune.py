"""Settings of the toxicity classifier by cross-validation on learnable rows alone.

    python -m tallyring.llm.tune TABLES [FOLDS]

reads documents and labels below a folder, leaves out every row whose crc32(doc_id as text) mod 3 is 1
before anything else, and prints, for each setting, recall and false alarms of texts that the
fold's training has not seen. A development tool: it reads a labelled sample into memory.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow.parquet as pq

from tallyring.llm import toxicity

GRID = {"GRAMS": [(3, 4, 5), (4, 5, 6), (3, 4, 5, 6)], "WINDOW": [10, 20, 64], "PAD": [300, 1000]}
PLACES = (0.05, 0.1, 0.2, 0.3)


def learnable(folder: str) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the rows that may teach."""
    labels = {d: t for d, t in zip(*(pq.read_table(f"{folder}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "toxic")), strict=True) if t in (0, 1) and zlib.crc32(str(d).encode()) % 3 != 1}
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    found = sorted((d, t or "") for d, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True) if d in labels)
    return [t for _, t in found], np.array([labels[d] for d, _ in found])


def fold(job: tuple) -> list[tuple[int, int, int, int]]:
    """Toxic and clean texts of a fold, and how many of each are found, for every place of the threshold."""
    folder, settings, k, folds = job
    for name, value in settings.items():
        setattr(toxicity, name, value)
    texts, labels = learnable(folder)
    of = np.random.default_rng(3).permutation(len(texts)) % folds
    model = toxicity.train([t for t, f in zip(texts, of, strict=True) if f != k], labels[of != k])
    own = [t.encode("utf-8", "surrogatepass") for t, f in zip(texts, of, strict=True) if f == k]
    p = model.scores(np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum([0, *map(len, own)]))
    # a place moves the intercept: what it adds to logits is known from the sample's edges
    sample = toxicity.Sample([t for t, f in zip(texts, of, strict=True) if f != k])
    clean, toxic = toxicity.edges(model, sample, labels[of != k])
    logit = np.log(np.maximum(p, 1e-300) / np.maximum(1 - p, 1e-300)) + np.log((1 - toxicity.THRESHOLD) / toxicity.THRESHOLD)
    now = clean + toxicity.PLACE * max(0.1, toxic - clean)
    said = [logit + now >= clean + place * max(0.1, toxic - clean) + 0.0 for place in PLACES]
    y = labels[of == k]
    return [(int(y.sum()), int(s[y == 1].sum()), int((y == 0).sum()), int(s[y == 0].sum())) for s in said]


def main(folder: str, folds: int = 3) -> None:
    settings = [dict(zip(GRID, v, strict=True)) for v in itertools.product(*GRID.values())]
    jobs = [(folder, s, k, folds) for s in settings for k in range(folds)]
    with ProcessPoolExecutor(8) as pool:
        done = list(pool.map(fold, jobs))
    for i, s in enumerate(settings):
        for j, place in enumerate(PLACES):
            toxic, found, clean, alarms = np.sum([done[i * folds + k][j] for k in range(folds)], axis=0)
            print(f"{s} PLACE {place}: recall {found}/{toxic} = {found / toxic:.3f}, false alarms {alarms}/{clean} = {alarms / clean:.4f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
