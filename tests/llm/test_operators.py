"""The ten operators against brute force, and on odd rows: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import html as markup
import math
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyring.llm import chat, contamination, counts, html, jaccard, likelihood, media, mixing, queries, scratch, store, tokens, toxicity, unigram
from tallyring.llm.components import components
from tallyring.ship import ship

BPE, PIECES = tokens.vocabulary(queries.BPE), tokens.vocabulary(queries.PIECES)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, size long, n long, word string, block long"
ODD = [
    (7, None, None, None, 1, 1, "w", 1),
    (3, "", "en", "a", 1, 1, "w", 1),
    (5, " \t\n ", "en", "a", 1, 1, "w", 1),
    (1, "One two THREE four five", "en", "b", 1, 1, "w", 1),
    (2, "one two three four five", "de", "b", None, None, None, None),
    (9, "One", "fr", None, 1, 1, "w", 1),
    (8, "ça  va\n\nbien 日本語 ☃ <|endoftext|> \x1c x", "fr", "é", 1, 1, "w", 1),
    (4, "long word " * 30000 + "end", "en", "a", 1, 1, "w", 1),
    (6, "one two three four five", "en", "b", 1, 1, "w", 1),
    (6, "one two three four five", "en", "b", 1, 1, "w", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


# 1
def test_chat(spark):
    rows = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "hi <\\|x"), (1, 2, "assistant", "<|im_start|>assistant no"), (1, 3, "user", None), (1, 4, "assistant", "word " * 400), (1, 5, "assistant", "ok<"), (2, None, None, "lone"), (2, None, None, "lone"), (None, 1, "a\nb\\", "x"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("window", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    windows = chat.format_windows(df, BPE, 120, 40)
    got = {r["conv_id"]: r for r in chat.read_back(windows.orderBy("window")).collect()}
    assert len(got) == 4
    for conv in (1, 2, None, 3):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        learnt = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(own), len(learnt))
    first = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(first) > 1 and all(w["over"] or w["n_tokens"] <= 120 for w in first)
    assert all(w["text"].startswith("<|im_start|>system") for w in first) and any(w["over"] for w in first)
    assert chat.read_back(chat.format_windows(df.limit(0), BPE)).count() == 0
    for text in ("<|", "<\\|", "<\\\\|<|x", "plain", "<<|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_chat_windows_keep_the_budget(spark, sf):
    """No window but those marked ``over`` has more tokens, as the library counts them, than the budget."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(BPE)
    exact.encode_special_tokens = True
    ship(spark)
    short = spark.range(600).select(F.lit(-5).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.lit("ok").alias("text"))
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(short)
    windows = chat.format_windows(table, BPE).collect()
    for w in windows:
        n = len(exact.encode(w["text"], add_special_tokens=False).ids)
        assert n == w["n_tokens"] and w["over"] == (n > chat.BUDGET)
    assert all(w["n_repeated"] + w["n_new"] == 1 for w in windows if w["over"])


def test_chat_query(spark, sf):
    """The registered query, conversation -1 included, against plain hashes."""
    rows = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    rows[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r["conv_id"]: r for r in queries.op1_chat(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for conv, own in rows.items():
        own = [x[1:] for x in sorted(own)]
        learnt = "".join(t for r, t in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert tuple(got[conv][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


# 2
def test_toxicity_on_labels(spark):
    """Held-out rows of the labelled table: what training alone finds, and how many it accuses."""
    ship(spark)
    sf = os.environ.get("TEST_LABELS_DIR", "/root/testdata/sf0.1")
    if not os.path.exists(sf):
        pytest.skip("no larger table")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.op2_toxicity(spark, sf).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = Counter((r["toxic"], r["predicted"]) for r in got if r["held_out"])
    # some 5 in 100 texts with label 1 hold nothing that others with it hold
    assert held[1, 1] >= 0.9 * (held[1, 0] + held[1, 1]) and held[0, 1] <= 0.01 * (held[0, 0] + held[0, 1])


def test_toxicity_held_out():
    r = np.random.default_rng(1)
    plain, bad = [f"w{i}ord" for i in range(300)], ["grumblefig", "snotwaffle", "muckspout"]
    def text(toxic):
        words = [str(w) for w in r.choice(plain, 60)]
        for _ in range(3 if toxic else 0):
            words.insert(int(r.integers(0, 60)), str(r.choice(bad)))
        return " ".join(words)
    labels = np.array([i % 4 == 0 for i in range(400)], dtype=np.int64)
    model = toxicity.train([text(y) for y in labels], labels)
    def score(texts):
        raw = [t.encode() for t in texts]
        return model.scores(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    held = [text(y) for y in labels]
    predicted = score(held) >= toxicity.THRESHOLD
    assert (predicted == labels).mean() > 0.97
    misspelt = [text(0) + " grumblefigg snottwaffle mucksspout " + text(0) for _ in range(20)]
    assert (score(misspelt) > np.median(score([text(0) for _ in range(20)]))).mean() > 0.9
    assert score(["", "  ", "ordinary"]).max() < toxicity.THRESHOLD


def test_toxicity_short_words_and_large_counts():
    """Words of one letter are in the bag; a count beyond 16 bits is kept whole."""
    raw = b"a b c"
    own, bucket = map(np.concatenate, zip(*toxicity.grams(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])), strict=True))
    assert len(bucket) == len(set(bucket.tolist())) == 3 and own.tolist() == [0, 0, 0]
    for extra in (0, 1, 70_000):
        words = ["x"] * toxicity.WINDOW * (toxicity.MOST + extra)
        sample = toxicity.Sample([" ".join(words)])
        assert sample.count.astype(int).sum() == sample.size[0] == toxicity.MOST + extra
        assert len(set(sample.bucket.tolist())) == 1 and len(sample.bucket) == -(-(toxicity.MOST + extra) // toxicity.MOST)


def test_toxicity_sample(spark):
    """Training takes 2,500 rows of a label where there are as many."""
    docs = spark.range(2700).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") >= 2600).cast("int").alias("toxic"))
    got = Counter(toxicity.labelled(docs, labels, F.lit(True))[1].tolist())
    assert got == {0: 2500, 1: 100}
    assert Counter(toxicity.labelled(docs, labels, F.lit(True), most=22)[1].tolist()) == {0: 4, 1: 4}


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["__score"] <= 1 for r in got)
    for labels_ in (labels.limit(0), labels.where("toxic = 1")):
        assert toxicity.score(odd, toxicity.fit(odd, labels_, F.lit(True))).count() == len(ODD)
    assert toxicity.score(none, model).count() == 0
    clash = odd.withColumn("size", F.col("text")).withColumn("__word", F.lit(1))
    assert toxicity.keep_clean(clash, model).columns == clash.columns
    with pytest.raises(ValueError):
        toxicity.score(odd.withColumn("__Score", F.lit(1)), model)
    long = [r["__score"] for r in got if r["doc_id"] == 4]
    again = toxicity.score(odd.unionByName(odd), model).where("doc_id = 4").collect()
    assert [r["__score"] for r in again] == long * 2


# 3
def brute(rows):
    sets = {}
    for doc, text in rows:
        w = spaced(text)
        sets[doc] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    up = {d: d for d in sets}
    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("rare", "block"), [(32, 128), (3, 7)])
def test_jaccard_groups(spark, monkeypatch, rare, block):
    """A large group of near copies around one text, small groups, passages that many share."""
    monkeypatch.setattr(jaccard, "RARE", rare)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PART", block)
    r = np.random.default_rng(5)
    word = lambda: f"w{r.integers(0, 10**6)}"
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(40)], []
    for _ in range(60):
        copy = list(base)
        for _ in range(int(r.integers(0, 7))):
            copy[int(r.integers(0, 120))] = word()
        rows.append(copy)
    for _ in range(20):
        own = [word() for _ in range(int(r.integers(5, 200)))]
        rows += [own[:1] + passage + own, own] + ([[*own, word()]] if len(own) > 60 else [])
    rows += [passage + [word() for _ in range(int(r.integers(0, 8)))] for _ in range(15)]
    texts = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join(df).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components_of_small_tables_take_few_tasks(spark, monkeypatch, kind):
    """Small tables are written by few tasks though many partitions are set and none are joined."""
    ship(spark)
    rng = np.random.default_rng(5)
    edges = {"random": rng.integers(0, 900, (600, 2)), "path": np.stack([np.arange(400), np.arange(1, 401)], 1)[rng.permutation(400)], "star": np.stack([np.full(700, 350), np.arange(700)], 1), "none": np.zeros((0, 2), dtype=np.int64)}[kind].tolist()
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    written, plain = [], scratch.table

    def table(df, name, *by):
        out = plain(df, name, *by)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(scratch, "table", table)
    set_ = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in set_}
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(edges, "u long, v long").repartition(7)
        got = {r["node"]: r["component"] for r in components(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {x: root(x) for x in up}
    assert max(written) <= 9


def test_jaccard_boilerplate(spark):
    """Three fifths that all documents share make no cluster of them, and few pairs."""
    ship(spark)
    shared = " ".join(f"s{i}" for i in range(60))
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared + " "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat(F.lit("own"), F.hash("id", k).cast("string"))), " ")).alias("text"))
    spoken = jaccard.classes(df)
    pairs = jaccard.candidates(df, spoken)
    assert pairs.count() < 300 and components(pairs).groupBy("component").count().agg(F.max("count")).first()[0] < 32
    got = jaccard.join(df.unionByName(df.where("doc_id = 7").withColumn("doc_id", F.lit(1000).cast("long")).withColumn("text", F.concat("text", F.lit(" more"))))).where("doc_id <> component_id").collect()
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(1000, 7)]


@pytest.mark.parametrize("rows", [1000, 4000])
def test_jaccard_shared_words_send_no_pairs(spark, rows):
    """200 words that all documents share and 20 of their own (similarity 0.81): texts that are compared
    grow no faster than rows, as no two sets meet outside what all share."""
    ship(spark)
    shared = " ".join(f"s{i}" for i in range(200))
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("own"), F.hash("doc_id", k).cast("string"))), " ")
    df = spark.range(rows).withColumnRenamed("id", "doc_id").withColumn("text", F.concat(F.lit(shared + " "), own))
    texts = df.select(F.lit(0).cast("long").alias("cluster"), "doc_id", F.lit(False).alias("linked"), "text")
    assert jaccard.blocks(texts).count() == 0
    near = texts.unionByName(texts.where("doc_id % 100 = 5").withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.concat("text", F.lit(" more"))}))
    assert jaccard.blocks(near).count() == 2 * (rows // 100)
    if rows == 1000:
        got = jaccard.join(near.select("doc_id", "text")).where("doc_id <> component_id").collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1_000_000 + i, i) for i in range(5, 1000, 100)]


@pytest.mark.parametrize("seed", range(4))
def test_jaccard_where_much_is_shared(spark, monkeypatch, seed):
    """85 to 92 % of the shingles are those of all: exact all the same, whatever the split does."""
    ship(spark)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    r = np.random.default_rng(seed)
    core, texts = [f"s{i}" for i in range(150)], []
    for i in range(60):
        words = list(core)
        kind = i % 4
        if kind == 0:  # a tail of its own
            words += [f"t{i}x{j}" for j in range(int(r.integers(8, 30)))]
        elif kind == 1:  # a hole, and a tail of a few kinds
            at = int(r.integers(0, 140))
            words[at : at + int(r.integers(0, 8))] = []
            words += [f"g{i % 3}x{j}" for j in range(int(r.integers(0, 25)))]
        elif kind == 2:  # replaced words
            for _ in range(int(r.integers(1, 5))):
                words[int(r.integers(0, 150))] = f"r{int(r.integers(0, 6))}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join(df).collect()}
    assert got == brute(texts)
    # every true link between sets of one cluster is inside one of the smaller clusters
    sets = {d: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for d, t in texts}
    rest = df.select(F.lit(0).cast("long").alias("cluster"), "doc_id", F.lit(False).alias("linked"), "text")
    part = {x["doc_id"]: x["cluster"] for x in jaccard.split(rest).collect()}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                assert part[a] == part[b]


def test_jaccard_levels():
    """Sets that may be similar share a level, for which g is not over their e."""
    for n in range(1, 3000):
        own = jaccard._level(n)
        assert jaccard._smallest(own) <= n < jaccard._smallest(own + 1)
        assert own - jaccard._level(jaccard.least(n)) in (0, 1)
        for level in (own, own + 1):
            assert jaccard.prefix(jaccard._smallest(max(0, level - 1)))[1] <= jaccard.prefix(n)[1]


def test_jaccard_odd(spark, odd, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(odd.unionByName(odd.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))).collect()}
    assert {(7, 0, 7), (3, 0, 3), (5, 0, 5), (1, 2, 1), (2, 2, 1), (6, 2, 1), (9, 1, 9), (None, 2, None)} <= got
    kept = jaccard.keep_one(odd)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 7, 8, 9] and kept.columns == odd.columns
    assert jaccard.join(none).count() == 0 and jaccard.keep_one(none).count() == 0
    repeated = jaccard.keep_one(odd.where("doc_id = 6"))
    assert repeated.count() == 1
    narrow = jaccard.join(odd.withColumn("doc_id", F.col("doc_id").cast("int")))
    assert narrow.schema["component_id"].dataType.simpleString() == "int" and narrow.where("component_id = 1").count() == 4
    with pytest.raises(ValueError):
        jaccard.join(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


# 4
def article(page):
    return " ".join(markup.unescape(re.sub(r"<[^>]*>", " ", re.search("<article>(.*)</article>", page, re.S)[1])).split())


@pytest.mark.parametrize("names", ["as they are", "noise", "none", "no article"])
def test_pages(spark, sf, names, monkeypatch):
    """All pages right, whatever class names say, and if the article is a div like others; without
    the tree none is."""
    ship(spark)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    if names == "no article":
        pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
        want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
        pages = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", "<div class=z>"), "</article>", "</div>"))
    elif names != "as they are":
        pages = pages.withColumn("html", F.regexp_replace("html", ' class="ad"', ' class="q7x"' if names == "noise" else ""))
    got = html.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    assert not any(html.kept_text(r["html"], frozenset(), {}) == want[r["page_id"]] for r in pages.limit(20).collect())


WORDS = [f"w{i}ord" for i in range(3000)]


def story(i, n=12):
    """Words that hardly another story has, and some that all have."""
    r = np.random.default_rng(1000 + i)
    return " ".join(x for k in range(n) for x in (str(r.choice(WORDS)), ("of", "the", "and")[k % 3]))


def page_table(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages_style_tree(spark):
    """Boxes that only their repetition tells go, also if a word in them differs; what differs by
    page stays; odd pages work."""
    page = "<html><body><div class=box><p>Try our blue soap today, user{1}, and save a lot of money at home</p></div><div class=story><p>{0} &amp; more</p></div><div role=search>me too</div><div itemprop='comment'>me too</div><form>f</form><aside>x</aside></body>"
    rows = [(i, "http://one.example/a", page.format(story(i), i)) for i in range(12)] + [(20, None, None), (21, "nohost", ""), (22, "http://two.example/", "<p>Just <b>this<p>and\n that<br>too<!-- c --><script>if (a<b) {}</script> &lt;x&gt;"), (23, "http://two.example/", "no markup < here")]
    df = page_table(spark, [*rows, rows[0], rows[0]]).withColumn("host", F.lit("clash")).withColumn("judged", F.lit("clash"))
    want = {i: f"{story(i)} & more" for i in range(12)} | {20: "", 21: "", 22: "Just this and that too <x>", 23: "no markup < here"}
    got = html.extract(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(rows) + 2
    assert html.extract(df.limit(0)).count() == 0


def test_pages_small_hosts(spark):
    """An advert beside a story goes even from a host of one page, by the share such branches hold
    elsewhere; equal sections stay."""
    page = "<body><div class={2}>{1} soap</div><div class={3}><h2>{0}</h2><p>{0}</p></div></body>"
    rows = [(i, f"http://h{i}.example/", page.format(story(i), f"Buy w{i}", "x1", "x2")) for i in range(40)]
    sections = "<body>" + "".join(f"<section class=s{k}><p>{{{k}}}</p></section>" for k in range(6)) + "</body>"
    rows += [(100 + i, "http://six.example/", sections.format(*(story(100 + 6 * i + k) for k in range(6)))) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html.extract(page_table(spark, rows)).collect()}
    assert got == {i: f"{story(i)} {story(i)}" for i in range(40)} | {100 + i: " ".join(story(100 + 6 * i + k) for k in range(6)) for i in range(9)}


@pytest.mark.parametrize("inside", [False, True])
@pytest.mark.parametrize("many", [lambda i: 3, lambda i: i % 6])
def test_pages_comments(spark, inside, many):
    """Comments of readers, different on every page: their form repeats. Sections with headings, columns
    that hold the story, and a short second story stay."""
    def comment(i, k):
        return f'<div class="q2"><p>{story(50_000 + 50 * i + k, 16)}</p></div>'

    rows, want = [], {}
    for i in range(150):
        said = '<div class="q1">' + "".join(comment(i, k) for k in range(many(i))) + "</div>"
        own = [story(3 * i + k, 45) for k in range(3)]
        body = "".join(f"<p>{t}</p>" for t in own)
        page = f"<html><body><article>{body}{said if inside else ''}</article>{'' if inside else said}</body></html>"
        rows.append((i, f"http://h{i % 5}.example/{i}", page))
        want[i] = " ".join(own)
    got = {r["page_id"]: r["text"] for r in html.extract(page_table(spark, rows)).collect()}
    assert got == want


def test_pages_sections_and_columns_stay(spark):
    rows, want = [], {}
    for i in range(60):
        lead, parts = story(7 * i, 60), [story(10_000 + 7 * i + k, 12) for k in range(4)]
        if i % 2:
            body = "".join(f"<section><h2>{story(20_000 + 7 * i + k, 2)}</h2><p>{t}</p></section>" for k, t in enumerate(parts))
            text = [lead, *[x for k, t in enumerate(parts) for x in (story(20_000 + 7 * i + k, 2), t)]]
            page = f"<article><p>{lead}</p><div>{body}</div></article>"
        else:
            page = "<article><div>" + "".join(f"<div><p>{t}</p></div>" for t in [lead, *parts]) + "</div></article>"
            text = [lead, *parts]
        rows.append((i, f"http://{'ab'[i % 2]}.example/{i}", f"<html><body>{page}</body></html>"))
        want[i] = " ".join(text)
    assert {r["page_id"]: r["text"] for r in html.extract(page_table(spark, rows)).collect()} == want


def test_pages_count_all_word_pairs(spark):
    """Every word pair of a node counts, however long its text, and once a page."""
    words = [f"w{i}" for i in range(1000)]
    rows = [(k, "https://h/", f"<body><p>{' '.join([*words, *words])} own{k}</p></body>") for k in range(3)]
    counted = html.features(spark.createDataFrame(rows, "page_id long, url string, html string")).where(F.col("kind") == html.PAIR)
    assert Counter(r["n"] for r in counted.collect()) == {3: 1000, 1: 3}


def test_pages_pairs_stay_no_rows(spark):
    """Sums over word pairs are those of the pairs one by one, a row a host and node, however many pairs."""
    rows = [(k, f"https://h{k % 3}/", f"<body><p>same words here {' '.join(f'w{i % 97 + k % 4}' for i in range(300 * k))}</p><div>w{k} own</div></body>") for k in range(12)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    each, on_host, on_all = html.features(table).collect(), Counter(), Counter()
    for r in each:
        if r["kind"] == html.PAIR:
            on_host[r["host"], r["node"], r["feature"]] += r["n"]
            on_all[None, r["node"], r["feature"]] += r["n"]
    got = html.features(table, each=False).collect()
    for kind, counts_ in ((html.OWN, on_host), (html.ALL, on_all)):
        n, h = Counter(), Counter()
        for (name, node, _), k in counts_.items():
            n[name, node] += k
            h[name, node] += k * math.log(k)
        found = {(r["host"], r["node"]): r for r in got if r["kind"] == kind}
        assert {k: r["n"] for k, r in found.items()} == n and all(r["share"] == pytest.approx(h[k]) for k, r in found.items())
    assert not any(r["kind"] == html.PAIR for r in got)
    other = lambda some: sorted((r["host"], r["node"], r["kind"], r["feature"], r["n"], round(r["share"], 9)) for r in some if html.PAIR < r["kind"] < html.OWN)
    assert other(each) == other(got)
    numbers = np.array([7, 7, 9, 2**32 - 1, 0, 3], dtype=np.uint32)
    assert html._unpack(html._pack(numbers)).tolist() == numbers.tolist()


def test_pages_copies_count_once(spark):
    """Copies, also those that differ in scripts and menus only, take no text from any page."""
    page = "<body><nav>{1}</nav><script>{1}</script><div class=box>Blue soap is good for you</div><div class=story>{0}</div></body>"
    copies = [(i, "http://same.example/", page.format(story(0), i % 5)) for i in range(40)]
    mixed = [(100 + i, "http://mixed.example/", page.format(story(max(0, i - 90)), i % 3)) for i in range(100)]
    got = {r["page_id"]: r["text"] for r in html.extract(page_table(spark, copies + mixed)).collect()}
    assert all(got[i].endswith(story(0)) for i in range(40))
    assert {i: got[100 + i] for i in range(100)} == {i: story(max(0, i - 90)) for i in range(100)}


def test_pages_tree_judges_inside_articles(spark):
    """What articles of a host repeat goes; an article on many pages stays, whatever surrounds it."""
    page = "<body><div class=box>Box {1}</div><article><p>{0}</p><div class=x>Join us now and here for more of this</div></article></body>"
    rows = [(i, "http://one.example/", page.format(story(i), i)) for i in range(12)] + [(20 + i, "http://two.example/", page.format(story(99), i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(page_table(spark, rows)).collect()}
    assert {i: got[i] for i in range(12)} == {i: story(i) for i in range(12)}
    assert all(story(99) in got[20 + i] for i in range(12))


def test_pages_all_class_names_tell_nodes(spark):
    """Siblings that differ in a late class are two nodes; numbers of items make no node a page."""
    few, many = "flex m-1 p-1", " ".join(f"utility-{k}" for k in range(30))
    page = "<body>" + "".join(f"<div class='post-{{1}} {c} w-1/2 x-note'>Join us now and here for more of this</div><div class='{c} w-1/2 y-text'>{{0}}</div>" for c in (few, many)) + "</body>"
    got = html.extract(page_table(spark, [(i, "http://one.example/", page.format(story(i), i)) for i in range(12)])).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"{story(i)} {story(i)}" for i in range(12)}


@pytest.mark.parametrize("odd", ["<a ", '<a x="', "<a \"'", "<div>", "<b>", "<p>", "</div>", "<table><tr><td>", "<![CDATA[", "<!--", "<", "&lt;"])
def test_long_pages_take_linear_time(odd):
    page, began = odd * (1_000_000 // len(odd)), time.process_time()
    assert sum(1 for _ in html.blocks(page)) <= 1
    assert time.process_time() - began < (2 if odd[:2] == "<a" else 5)
    said = [x for _, x, _ in html.blocks(odd + " text>" + "<p>more")]
    assert said == [] if odd == "<!--" else said[-1].endswith("more")


# 5
def test_fm_index():
    r = np.random.default_rng(2)
    for n, k in ((1, 2), (50, 3), (400, 4)):
        s = r.integers(1, k, n)
        index = contamination.FMIndex(s, k)
        for size in (1, 2, 5, 13):
            patterns = np.array([s[i : i + size] for i in range(max(0, n - size + 1))] + [r.integers(1, k, size) for _ in range(5)])
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi, strict=True):
                assert sorted(index.locate(np.arange(a, b))) == [i for i in range(n - size + 1) if np.array_equal(s[i : i + size], p)]


def test_contamination_odd(spark, odd, none, monkeypatch):
    items = [("b", "One two three"), ("a", "two THREE four, five"), ("c", None), ("d", " !! "), ("b", "One two three"), (None, "word end"), ("z", " ".join(f"q{i}" for i in range(30)))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [(r[0], r[1]) for r in ODD] + [(50, "start " + " ".join(f"Q{i}" for i in range(10, 24)) + " rest")]
    df = odd.unionByName(spark.createDataFrame([(*texts[-1], *[None] * 6)], SCHEMA))
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = word(t)
        for j in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + min(13, len(w))]), set()).add(i or "")
    want = Counter()
    for d, t in texts:
        w, hit, found = word(t), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if own := windows.get(tuple(w[j : j + size])):
                    hit |= set(range(j, j + size))
                    found |= own
        want[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for block in (1 << 20, 10):
        monkeypatch.setattr(contamination, "BLOCK", block)
        assert Counter(map(tuple, contamination.report(df, bench).collect())) == want
    spans = {r["doc_id"]: r["found"]["spans"] for r in contamination.find(df, bench).collect()}
    clash = df.withColumnsRenamed({"size": "__spans", "n": "found"})
    assert contamination.clean(clash, bench).columns == clash.columns
    with pytest.raises(ValueError):
        contamination.find(clash, bench)
    assert ODD[3][1][spans[1][0]["start"] : spans[1][0]["end"]] == "One two THREE four five"
    assert contamination.clean(df, bench).columns == df.columns
    assert contamination.report(none, bench).count() == 0 and contamination.report(odd, bench.limit(0)).where("contaminated").count() == 0


# 6
def test_token_counts(docs, odd, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *unigram.pieces(PIECES)], 0))
    exact.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    for df in (docs.select("doc_id", "text"), odd):
        want = sorted((r["doc_id"], len(exact.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
        assert sorted((r["doc_id"], r["n_tokens"]) for r in counts.count(df, PIECES).collect()) == want
    assert counts.count(none, PIECES).count() == 0
    counter = unigram.Counter(unigram.pieces(PIECES))
    random = np.random.default_rng(4)
    for _ in range(2000):
        w = "".join(random.choice(list("thearno☃😀éx<unk>▁"), int(random.integers(1, 12))))
        assert counter.word(w) == len(exact.encode(w, add_special_tokens=False).ids)


# 7
def test_encoder_cuts_texts_right():
    """Parts encode as the whole does, whatever white space and marks stand where."""
    coder = tokens.Encoder(BPE, keep=2000)
    r = np.random.default_rng(6)
    letters = [*" \n\t ab1'sé  ☃.!\u00a0\u3000\u2003\u2028\x85\x1c<|", "  ", "\n\n"]
    texts = ["".join(r.choice(letters, int(r.integers(0, 14)))) for _ in range(5000)] + ["", " ", "word " * 500, "x" * 3000]
    for text, ids in zip(texts, coder.texts(texts), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.held() <= 2000 + 16 * tokens.LONG
    assert coder.dtype == np.dtype("<u2")


def test_token_store(spark, docs, odd, none):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(BPE)
    exact.encode_special_tokens = True
    for df in (docs.select("doc_id", "text"), odd, none, odd.withColumn("doc_id", F.when(F.col("doc_id") < 5, F.col("doc_id")))):
        path = scratch.folder(spark, "t")
        store.write(df, path, BPE)
        store.manifest(spark, path)
        rows = df.collect()
        got = sorted(store.read_back(spark, path).collect(), key=lambda r: r["start"])
        ids = lambda t: [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        start = 0
        for r in got:
            assert r["start"] == start
            start += r["n_tokens"]
        key = lambda d: (d is not None, d or 0)
        assert [key(r["doc_id"]) for r in got] == sorted(key(r["doc_id"]) for r in rows)
        want = Counter((r["doc_id"], len(ids(r["text"])), zlib.crc32(np.array(ids(r["text"]), dtype="<u4").tobytes())) for r in rows)
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        if rows and len(rows) == len(ODD):
            assert Counter(tuple(r["ids"]) for r in store.documents(spark, path).collect()) == Counter(tuple(ids(r["text"])) for r in rows)
        digests = [r[0] for r in spark.read.parquet(f"{path}/chunks").select("digest").collect()]
        assert len(digests) == len(set(digests)) and len(store.top(spark, path)) == 16
    assert store.crc_join([(zlib.crc32(b"ab"), 2), (zlib.crc32(b"c" * 999), 999)]) == zlib.crc32(b"ab" + b"c" * 999)


def test_token_store_finds_damage(spark, odd):
    path = scratch.folder(spark, "t")
    store.write(odd, path, BPE)
    chunks = spark.read.parquet(f"{path}/chunks")
    chunks.withColumn("ids", F.expr("concat(ids, x'0000')")).write.parquet(f"{path}/bad/chunks")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{path}/bad/recipes")
    with pytest.raises(Exception, match="digest"):
        store.read_back(spark, f"{path}/bad").collect()


def test_token_store_verifies_recipes(spark, odd):
    """Recipes must give their roots and tokens, leaves the manifest; whole documents cannot vanish."""
    path = scratch.folder(spark, "t")
    store.write(odd, path, BPE)
    store.manifest(spark, path)
    recipes, chunks, leaves = (spark.read.parquet(f"{path}/{t}") for t in ("recipes", "chunks", "manifest"))
    some = recipes.where("size(digests) = 1").select(F.col("digests")[0].alias("digest")).limit(1)
    long = F.size("digests") > 1
    assert store.read_back(spark, path).count() == len(ODD) and recipes.where(long).count() == 1
    cases = [
        ("do not give its root", recipes.withColumn("digests", F.reverse("digests")), chunks, leaves),
        ("do not give its root", recipes.withColumn("digests", F.when(long, F.expr("slice(digests, 2, 999)")).otherwise(F.col("digests"))), chunks, leaves),
        ("do not give its root", recipes.withColumn("digests", F.expr("slice(digests, 1, 0)")), chunks, leaves),
        ("do not hold its", recipes.withColumn("n_tokens", F.col("n_tokens") + 1), chunks, None),
        ("not those of the manifest", recipes.withColumn("n_tokens", F.col("n_tokens") + 1), chunks, leaves),
        ("not those of the manifest", recipes.where(~long), chunks, leaves),
        ("not those of the manifest", recipes, chunks, leaves.unionByName(leaves.limit(1))),
        ("has no manifest", recipes, chunks, False),
        ("lacks 1 of", recipes, chunks.join(some, "digest", "left_anti"), leaves),
    ]
    for k, (says, r, c, m) in enumerate(cases):
        bad = f"{path}/bad{k}"
        r.write.parquet(f"{bad}/recipes")
        c.write.parquet(f"{bad}/chunks")
        if m is None:
            store.manifest(spark, bad)
        elif m is not False:
            m.write.parquet(f"{bad}/manifest")
        with pytest.raises(Exception, match=says):
            store.read_back(spark, bad).collect()


# 8
def lattice_total(p, text):
    """Sum over all segmentations, one by one."""
    return 1.0 if not text else sum(q * lattice_total(p, text[len(n) :]) for n, q in p.items() if n and text.startswith(n))


def test_likelihood(spark, docs, odd, none):
    """Counts and base against plain sums; the score against all segmentations of short texts."""
    short = [(20_000_000, "a an", "x"), (20_000_001, "The to THE", None), (20_000_002, "☃", "x"), (20_000_003, "of the", "x")]
    extra = spark.createDataFrame(short, "doc_id long, text string, lang string")
    df = docs.select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 10_000_000, "text").toDF("doc_id", "text")).unionByName(extra.select("doc_id", "text")).withColumn("h", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("c", F.lit("clash"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    rows = {r["doc_id"]: r for r in df.withColumn("held", held).collect()}
    c, ends = Counter(), 0
    for r in df.withColumn("held", held).collect():
        if not r["held"]:
            c.update(spaced(r["text"]))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    got = likelihood.score(df, held, PIECES).collect()
    assert len(got) == df.count()
    for r in got:
        w = spaced(rows[r["doc_id"]]["text"])
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (rows[r["doc_id"]]["held"], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    lattice, scores = likelihood.vocabulary(PIECES)
    words, counts_ = list(c), np.array(list(c.values()))
    measure = lambda ts: list(zip(*[(lattice.score(words, [unigram.weights(scores, t, e) for t in ts]) * counts_).sum(axis=1) for e in (0.0, likelihood.STEP)], strict=True))
    found = likelihood.fitted(scores, measure)[0]
    temperature, pieces = likelihood.best(found)
    end = ends / (ends + pieces)
    log_p = unigram.weights(scores, temperature, end)
    p = dict(zip(lattice.names, np.exp(log_p), strict=False))
    by_id = {r["doc_id"]: r for r in got}
    for doc, text, _ in short:
        total = math.log10(end)
        for w in spaced(text):
            some = {n: q for n, q in p.items() if n in "▁" + w}
            some |= {x: math.exp(log_p[-1]) * 256.0 ** -len(x.encode()) for x in "▁" + w if x not in p}
            total += math.log10(lattice_total(some, "▁" + w))
        assert by_id[doc]["score"] == pytest.approx(total, rel=1e-6)
    # the temperature is near the best there is
    near = [t for t in np.exp(np.linspace(np.log(min(found)), np.log(max(found)), 15))]
    all_ = (lattice.score(words, [unigram.weights(scores, t) for t in [*near, temperature]]) * counts_).sum(axis=1)
    assert all_[-1] >= all_[:-1].max() - 0.01 * abs(all_[-1])
    assert likelihood.score(none, F.lit(False), PIECES).count() == 0
    assert likelihood.score(odd, F.lit(True), PIECES).count() == len(ODD)


def test_likelihood_query(spark, sf):
    """What is held out, that counts come from training rows alone, and that no row is missing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op8_likelihood(spark, sf).collect()}
    assert got.keys() == {r["doc_id"] for r in docs}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in docs}
    assert all(got[d]["held_out"] == h for d, h in held.items())
    assert all(r["train_tokens"] == sum(len(spaced(d["text"])) + 1 for d in docs if not held[d["doc_id"]]) for r in got.values())


@pytest.mark.parametrize("true", [1e-3, 0.2, 1.0, 40.0, 1e5])
def test_temperature_is_found_wherever_it_lies(true):
    """Words drawn with the scores over a temperature, whatever the spread of the scores."""
    names = ["▁a", "▁b", "▁c", "▁ab", "a", "b", "c"]
    for unit in (1.0, 3000.0):
        scores = unit * true * np.array([-0.5, -1.5, -3.0, -1.0, -2.0, -2.5, -4.0])
        lattice = unigram.Lattice(names)
        p = unigram.weights(scores, unit * true)
        words = ["a", "b", "c", "ab", "ac", "bb"]
        counts_ = np.exp(lattice.score(words, [p])[0]) * 1e6
        measure = lambda ts: [tuple((lattice.score(words, [unigram.weights(scores, t, e)])[0] * counts_).sum() for e in (0.0, likelihood.STEP)) for t in ts]  # noqa: B023, E731
        at, _ = likelihood.best(likelihood.fitted(scores, measure)[0])
        reach = (lattice.score(words, [unigram.weights(scores, t) for t in np.exp(np.linspace(np.log(at) - 8, np.log(at) + 8, 161))]) * counts_).sum(axis=1)
        here = (lattice.score(words, [unigram.weights(scores, at)])[0] * counts_).sum()
        assert here >= reach.max() - 0.02 * abs(here)


@pytest.mark.parametrize("tiny", [1e-280, 2.0])
def test_lattice_uses_are_counted_once_a_table(monkeypatch, tiny):
    """One array of the vocabulary's length a table and round, not one an edge; uses of "ab" by hand."""
    lattice = unigram.Lattice([unigram.START, unigram.START + "a", "a", "b", "ab"])
    monkeypatch.setattr(unigram.Lattice, "TINY", tiny)  # 2: all in logs
    calls, plain = [], np.bincount
    monkeypatch.setattr(unigram.np, "bincount", lambda *a, **b: calls.append(1) or plain(*a, **b))
    p = np.array([0.1, 0.2, 0.3, 0.15, 0.2, 0.05])
    got = lattice.uses(np.frombuffer("ab".encode("utf-32-le"), dtype=np.uint32), np.array([0]), np.array([2]), None, np.log(p), 1)
    ways = {(0, 2, 3): 0.1 * 0.3 * 0.15, (1, 3): 0.2 * 0.15, (0, 4): 0.1 * 0.2}
    want = np.zeros(6)
    for way, chance in ways.items():
        want[list(way)] += chance / sum(ways.values())
    assert np.allclose(got, want, rtol=1e-12) and len(calls) == 1


def test_lattice_looks_up_an_end_at_once(monkeypatch):
    """One lookup an end and table, few words of many lengths in one table; each word's sums and uses as when it stands alone."""
    names = ["▁", "▁a", "a", "b", "ab", "▁ab", "bab"]
    lattice, calls, plain = unigram.Lattice(names), [], unigram.Lattice._find
    log_p = np.log(np.array([0.2, 0.25, 0.1, 0.15, 0.05, 0.1, 0.05, 0.1]))
    words = ["", "a", "ab", "b" * 7, "ba☃b", "é\0ab𝄞", "ab" * 12, "b" * 38, "ab" * 30, "aé" * 45, "b" * 500]
    length = np.array(list(map(len, words)))
    args = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), np.cumsum(length) - length, length
    monkeypatch.setattr(unigram.Lattice, "_find", lambda *a: calls.append(1) or plain(*a))
    sums = lattice.score(words, [log_p, log_p - 1.0])
    # tables that end at 2, 7, 38, 90 and 500 letters, and START
    assert len(calls) <= 3 + 8 + 39 + 91 + 501
    assert np.allclose(sums, np.hstack([lattice.score([w], [log_p, log_p - 1.0]) for w in words]), rtol=1e-12)
    for tiny in (1e-280, 2.0):  # 2: all in logs
        monkeypatch.setattr(unigram.Lattice, "TINY", tiny)
        alone = sum(lattice.uses(args[0], args[1][k : k + 1], args[2][k : k + 1], None, log_p, 1) for k in range(len(words)))
        assert np.allclose(lattice.uses(*args, None, log_p, 1), alone, rtol=1e-10)


def test_lattice_sums_all_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "▁ab"]
    log_p = np.log(np.array([0.2, 0.3, 0.1, 0.15, 0.05, 0.1, 0.1]))
    lattice = unigram.Lattice(names)
    p = dict(zip(names, np.exp(log_p), strict=False))
    words = ["a", "ab", "aab", "bab", "b" * 30, "b" * 60, "ab" * 9 + "b" * 30]
    sums = lattice.score(words, [log_p, log_p - 1.0])
    assert np.allclose(np.exp(sums[0][:5]), [lattice_total(p, "▁" + w) for w in words[:5]])
    assert sums[0][5] == pytest.approx(np.log(0.2) + 60 * np.log(0.15))
    for places in (22, 1):  # with room for every piece, and with nearly all beside their place
        lattice.PLACES = places
        lattice.__init__(names)
        assert np.allclose(lattice.score(words, [log_p, log_p - 1.0]), sums)
    assert len(lattice.beside) >= 4
    for plain in (40, 0):  # plain numbers and logs agree
        lattice.PLAIN = plain
        assert np.allclose(lattice.score(words, [log_p, log_p - 1.0]), sums)
    assert lattice.score(["☃"], [log_p])[0][0] == pytest.approx(np.log(p["▁"]) + log_p[-1] - 3 * np.log(256))
    w = unigram.weights(np.array([-2.0, -3.0, -50.0]), 2.0, 0.25)
    assert np.exp(w).sum() == pytest.approx(0.75) and w[0] - w[1] == pytest.approx(0.5) and w[-1] == w[2] - unigram.PENALTY / 2


def test_expected_uses_of_pieces():
    """One round against all segmentations of words; plain numbers and logs agree; rounds gain likelihood."""
    names = ["▁", "▁a", "a", "b", "ab", "▁ab"]
    log_p = np.log(np.array([0.2, 0.3, 0.1, 0.15, 0.05, 0.1, 0.1]))
    lattice, p = unigram.Lattice(names), dict(zip(names, np.exp(log_p), strict=False))

    def all_ways(text):
        return [[]] if not text else [[n, *rest] for n in names if text.startswith(n) for rest in all_ways(text[len(n) :])]

    words = ["a", "ab", "aab", "bab", "abab"]
    want = Counter()
    for w in words:
        ways = all_ways("▁" + w)
        total = sum(math.prod(p[x] for x in way) for way in ways)
        for way in ways:
            for x in way:
                want[x] += math.prod(p[y] for y in way) / total
    args = np.array([ord(x) for w in words for x in w], dtype=np.uint32), np.cumsum([0, *map(len, words)])[:-1], np.array(list(map(len, words)))
    update = lambda use: unigram.updated(use, log_p, 1e-9)
    plain = lattice.uses(*args, update, log_p, 1)
    assert np.allclose(plain, [*[want[n] for n in names], 0.0])
    lattice.PLAIN = 0
    assert np.allclose(lattice.uses(*args, update, log_p, 1), plain) and np.allclose(np.exp(update(plain)).sum(), 1)
    assert lattice.score(words, [update(plain)]).sum() > lattice.score(words, [log_p]).sum()


def test_learnt_likelihood(spark, sf, odd, none):
    """Held-out texts are near the base, the likelihood of all known words is what unknown ones leave, in
    texts of one and of two words, and an unknown word's is small, not nothing."""
    d = queries.op8_likelihood(spark, sf).where("held_out").toPandas()
    assert np.isfinite(d["score"]).all() and (d["score"] < 0).all()
    assert d["score"].sum() > 1.25 * d["base_score"].sum()
    known = ["the", "of", "theof", "ünd", "☃", "undder"]
    rows = [(k, " ".join(known[: k + 1] * (1 + k % 2)), "de" if k > 2 else "en", False) for k in range(6)] + [(6, "und der x", None, False)]
    asked = [*known, *[f"{a} {b}" for a in known for b in known], "ofthe", "q" * 3000, "", None]
    rows += [(100 + k, t, "fr", True) for k, t in enumerate(asked)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, held boolean")
    for classes in (F.col("lang"), None):
        got = {r["doc_id"]: r for r in likelihood.learnt(table, F.col("held"), PIECES, classes).collect()}
        assert len(got) == len(rows) and all(math.isfinite(r["score"]) for r in got.values())
        c = Counter(w for r in rows if not r[3] for w in r[1].split())
        n = sum(c.values()) + 7
        unseen = (sum(x == 1 for x in c.values()) + 1) / (n + 2)
        end = math.log10((1 - unseen) * 7 / n)
        assert all(got[100 + k]["score"] - end == pytest.approx(math.log10((1 - unseen) * c[w] / n)) for k, w in enumerate(known))
        share = (1 - unseen) * sum(c[w] for w in known) / n
        pairs = sum(10 ** (got[106 + k]["score"] - end) for k in range(36))
        # words that are no texts here ("und", "der", "x") have the rest
        assert pairs <= ((1 - unseen) * (n - 7) / n) ** 2 + 1e-12 and pairs == pytest.approx(share**2, rel=0.3)
        assert got[142]["score"] < math.log10(unseen) + end and got[144]["score"] == got[145]["score"] == pytest.approx(end)
    assert likelihood.learnt(none, F.lit(False), PIECES).count() == 0
    assert likelihood.learnt(odd, F.lit(True), PIECES, F.col("lang")).count() == likelihood.learnt(odd, F.lit(False), PIECES, F.col("lang")).count() == len(ODD)


# 9
def test_media(spark, docs, odd, none):
    for df in (docs.select("doc_id", "text"), odd):
        rows = Counter()
        for r in df.collect():
            data = (r["text"] or "").encode()
            padded = data + b" " * (-len(data) % 192 if data else 192)
            rows[r["doc_id"], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), hashlib.sha256(media.to_png(padded)).hexdigest(), media.feature(padded)] += 1
        got = media.store_and_describe(df).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"], r["feature"]) for r in got) == rows
    assert media.store_and_describe(none).count() == 0


def test_media_retries(spark, odd, monkeypatch):
    """A read that fails, comes short or comes broken is made again from a new handle, then raises."""
    monkeypatch.setattr(media, "PAUSE", 0.0)
    listed = media.pack(odd.where("doc_id <> 4"), scratch.folder(spark, "media"))
    reader = media.ArchiveReader({"list": listed, "rangebytes": "300"})
    parts, real, directory = reader.partitions(), reader.fetch, reader.directory
    read = lambda: sum(b.num_rows for p in parts for b in reader.read(p))
    assert read() == 9 and len(parts) > 1
    for failure in ("short", "empty", "broken", "raises"):
        calls = []
        def fetch(archive, lo, n, failure=failure, calls=calls):
            calls.append(lo)
            data = real(archive, lo, n)
            if len(calls) % 3 == 0:
                return data
            if failure == "raises":
                raise OSError("gone")
            return {"short": data[:-1], "empty": b"", "broken": data[:-1] + bytes([data[-1] ^ 1])}[failure]
        reader.fetch = fetch
        assert read() == 9 and len(calls) > 9
    tries = []
    def once(archive):
        tries.append(archive)
        if len(tries) % 2:
            raise OSError("gone")
        return directory(archive)
    reader.fetch, reader.directory = real, once
    assert read() == 9
    reader.directory, reader.fetch = directory, lambda *a: b""
    with pytest.raises(OSError, match="after 3 more tries"):
        read()
    with pytest.raises(Exception, match="doc_id of over"):
        media.pack(spark.createDataFrame([("x" * 40_000, "t")], "doc_id string, text string"), scratch.folder(spark, "media"))


def test_media_form():
    """The stored form is a PNG that any reader knows: by its sections, written down here."""
    data = bytes(range(192)) * 2
    want = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", bytes([0, 0, 0, 64, 0, 0, 0, 2, 8, 2, 0, 0, 0])), (b"IDAT", zlib.compress(b"".join(b"\0" + data[k : k + 192] for k in (0, 192)), 6)), (b"IEND", b"")):
        want += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    assert media.to_png(data) == want and media.from_png(want) == data
    with pytest.raises(ValueError):
        media.from_png(want.replace(b"IDAT", b"IDAX"))
    reds = np.frombuffer(data, dtype=np.uint8)[0::3].astype(float)
    assert media.feature(data).startswith(f"2x64 {reds.mean():.3f}/{reds.std():.3f} ")


# 10
def mix_targets(sizes):
    """Shares by weight, one source after the other cut off at 3 times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        left, shares = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and left * weight[s] > 3 * sizes[s] * shares}
        if not above:
            return {s: float(3 * sizes[s]) if s in capped else left / shares * weight[s] for s in order}
        capped |= above


def test_mixing(spark, docs, odd, none):
    keep = lambda df: scratch.table(df, "mix")
    for df in (docs, odd):
        got = mixing.mix(df, keep).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(3), keep).collect()), key=str)
        sizes = Counter()
        for r in df.collect():
            sizes[r["source"]] += len(spaced(r["text"]))
        goal = mix_targets(dict(sizes))
        assert all(any(r["target"] == pytest.approx(g) for g in goal.values()) for r in got)
        assert sum(goal.values()) == pytest.approx(sum(sizes.values())) and all(goal[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
        assert len(got) == df.count() and all(r["taken"] <= 3 * r["size"] for r in got)
        copies = mixing.resample(df, keep)
        assert copies.columns == df.columns
        assert sum(len(spaced(r["text"])) for r in copies.select("text").collect()) == sum(r["taken"] for r in got)
    by = {}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in mixing.mix(docs, keep).collect():
        taken, target, most = by.get(source[r["doc_id"]], (0, r["target"], 0))
        by[source[r["doc_id"]]] = (taken + r["taken"], target, max(most, r["size"]))
    assert all(abs(taken - target) <= most for taken, target, most in by.values())
    assert mixing.mix(none, keep).count() == 0
    r = np.random.default_rng(9)
    cases = [{"a": 10, "b": 0, None: 30}, {"x": 0}, *[{f"s{k}": int(r.integers(0, 10 ** int(r.integers(1, 6)))) for k in range(int(r.integers(1, 30)))} for _ in range(12)]]
    for case in cases:
        sums = spark.createDataFrame(list(case.items()), "source string, total long")
        found = {x["source"]: x["target"] for x in mixing.targets(sums).collect()}
        assert found == pytest.approx(mix_targets(case))
    clash = docs.withColumns({"size": F.lit("mine"), "hash": F.lit("mine"), "copies": F.lit("mine"), "of": F.lit("mine"), "__mix_size": F.lit("mine")})
    rows = mixing.resample(clash, keep)
    assert rows.columns == clash.columns and rows.select("size", "hash", "copies", "of", "__mix_size").distinct().collect() == [("mine",) * 5]
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
