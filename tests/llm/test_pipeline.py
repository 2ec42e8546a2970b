"""The corpus pipeline: stages one by one, and the whole."""

from pyspark.sql import functions as F

import corpus_pipeline
from tallyring.llm import contamination, jaccard, toxicity
from tallyring.llm import queries as own


def test_stages(spark, sf, tmp_path):
    import __spark_entry__ as contract

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    predicted = {r["doc_id"]: r["predicted"] for r in contract.queries()["op2_toxicity"](spark, sf).collect()}
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, sf)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        ids, had = [r["doc_id"] for r in after.select("doc_id").collect()], [r["doc_id"] for r in before.select("doc_id").collect()]
        assert set(ids) <= set(had)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        if name == "toxicity":
            assert sorted(ids) == sorted(d for d in had if not predicted[d])
        if name == "ngram_jaccard_join":
            assert sorted(ids) == sorted(r["doc_id"] for r in jaccard.join(before).where("doc_id = component_id").collect())
        if name == "benchmark_decontamination":
            bad = {r["doc_id"] for r in contamination.report(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
            assert bad and sorted(ids) == sorted(set(had) - bad)
        if name == "token_store":
            assert sorted(ids) == sorted(had)
        before = after
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert toxicity.THRESHOLD == 0.7 and "op2_toxicity" in own.queries()


ODD = [
    (7, None, None, None, None),
    (3, "", "en", "a", 0),
    (5, " \t\n ", "en", "a", 4),
    (1, "One two THREE four five six seven eight", "en", "b", 1),
    (2, "one two three four five six seven eight", "de", "b", None),
    (9, "One", "fr", None, 1),
    (4, "long word " * 30000 + "end", "en", "a", 1),
    (6, "one two three four five six seven eight", "en", "b", 1),
    (6, "one two three four five six seven eight", "en", "b", 1),
    (None, "no id at all", "en", "b", 1),
]


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and an empty table pass every
    stage, which gives back the columns it got and none but rows it got."""
    names = ["size", "hash", "copies", "of", "row", "found", "score", "window", "block", "part", "n", "u", "v", "cluster", "__mix_size", "__spans", "__score"]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars int").select("*", *[F.lit("mine").alias(n) for n in names])
    for table in (docs, docs.limit(0)):
        before = table.collect()
        kept = {}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, table, sf)
            assert got.columns == table.columns
            kept[name] = got.collect()
            assert {tuple(r) for r in kept[name]} <= {tuple(r) for r in before}
        if before:
            assert len(kept["toxicity"]) == len(before)
            assert sorted((r["doc_id"] or 0) for r in kept["ngram_jaccard_join"]) == [0, 1, 3, 4, 5, 7, 9]
            assert len(kept["benchmark_decontamination"]) == len(before)
        last = corpus_pipeline.STAGES[-1][1](spark, table, sf).collect()
        assert sorted(str(r["doc_id"]) for r in last) == sorted(str(r["doc_id"]) for r in before)
        assert all(r["n_tokens"] >= 1 for r in last)


def test_registered_queries(spark, sf):
    """Values of registered queries against plain programs: the classes of the Jaccard join, counts,
    ids and images; the others have tests or SQL of their own."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer, models, pre_tokenizers

    import __spark_entry__ as contract
    from tallyring.llm import media, tokens, unigram
    from tests.llm.test_operators import brute

    run = {n: (lambda n=n: contract.queries()[n](spark, sf).collect()) for n in own.queries()}
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run["op3_jaccard"]()} == brute(list(rows.items()))
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *unigram.pieces(own.PIECES)], 0))
    exact.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    assert {r["doc_id"]: r["n_tokens"] for r in run["op6_token_counts"]()} == {d: len(exact.encode(t, add_special_tokens=False).ids) for d, t in rows.items()}
    exact, start, want = Tokenizer.from_file(tokens.vocabulary(own.BPE)), 0, {}
    exact.encode_special_tokens = True
    for d in sorted(rows):
        ids = [*exact.encode(rows[d], add_special_tokens=False).ids, 0]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run["op7_token_store"]()} == want
    for r in run["op9_media"]():
        data = rows[r["doc_id"]].encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (len(data), len(padded), zlib.crc32(padded[-16:]), len(media.to_png(padded)))
    for name in ("op2_toxicity", "op5_decontaminate", "op8_likelihood", "op10_mix"):
        assert sorted(r["doc_id"] for r in run[name]()) == sorted(rows)
