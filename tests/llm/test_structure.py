"""Operators 11 to 13 against brute force, and on odd rows: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from tallyring.llm import interaction, queries, repair, topk
from tallyring.ship import ship

SPACE = "[^\\x20\\x09-\\x0D]"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# 11
def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def grammatical(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def brute_repair(rows):
    """Faults, then Dijkstra's search over whole edit sequences by (cost, labels)."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = re.findall(SPACE, text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, best = [(0, "", 0, "", ())], {}
    answer = None
    while heap:
        cost, labels, i, roles, lines = heapq.heappop(heap)
        if answer and cost > answer[0]:
            break
        if i == len(rows) and grammatical(roles) and (answer is None or (cost, labels) < answer[:2]):
            answer = (cost, labels, lines)
        # paths that end in a row's label, as insertions may follow differently
        if best.setdefault((i, roles, labels), cost) < cost:
            continue
        grown = []
        if i < len(rows):
            _, role, text = rows[i]
            stay = faults[i] == "truncated"
            grown.append((cost + 3, labels + "D", i + 1, roles, lines))
            if faults[i] not in ("blank", "duplicate"):
                grown.append((cost + stay, labels + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                grown += [(cost + 2 + stay, labels + "R", i + 1, roles + n[0], (*lines, f"{n}:{text}")) for n in ("user", "assistant")]
        grown += [(cost + 2, labels + "I", i, roles + n[0], (*lines, f"{n}:")) for n in ("user", "assistant")]
        for g in grown:
            if re.fullmatch("s?(ua)*u?", g[3]) and g[0] <= 3 * len(rows):
                heapq.heappush(heap, g)
    cost, labels, lines = answer
    kinds = [sum(f == k for f in faults) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *kinds, illegal, cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def got_repairs(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_repair_odd_rows(spark):
    rows = [
        (None, 1, "user", "Hi."), (None, None, None, None), (1, 0, "system", "Be."), (1, 1, "user", "Ask!"), (1, 1, "user", "Ask!"), (1, 2, "assistant", "Say"),
        (2, 5, "assistant", "No."), (2, 9, "", "x."), (3, None, "user", "a."), (3, None, "user", "b. \n\t"), (4, 0, "user", ""), (4, 1, "assistant", " \r\n "),
        (5, 0, "tool", "é☃."), (5, 1, "user", "y" * 200000 + "?"), (5, 2, "assistant", "z."), (6, 0, "s", "k."), (6, 7, "u", "l."), (6, 8, "a", "m."), (6, -3, "system", "n."),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, seen int")
    assert got_repairs(repair.repair(repair.damage(df))) == {c: brute_repair(v) for c, v in brute_damage(rows).items()}
    assert repair.repair(repair.damage(df.limit(0))).count() == 0
    named = df.selectExpr("string(conv_id) conv_id", "turn", "role", "text")
    assert {r.conv_id for r in repair.repair(repair.damage(named)).collect()} == {None, *map(str, range(1, 7))}


def test_repair_random(spark):
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["system", "user", "user", "assistant", "assistant", "tool"]), draw.choice(["a.", "b!", "c", "", "d?"])) for c in range(150) for t in range(draw.randint(0, 5))]
    damaged = [(c, t, r, x, False) for c, t, r, x in rows]
    whole = spark.createDataFrame(damaged, "conv_id long, turn long, role string, text string, dropped boolean")
    grouped = defaultdict(list)
    for c, t, r, x, _ in damaged:
        grouped[c].append((t, r, x))
    assert got_repairs(repair.repair(whole)) == {c: brute_repair(v) for c, v in grouped.items()}


def test_repair_query_and_damage(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_repairs(queries.op11_repair(spark, sf)) == {c: brute_repair(v) for c, v in brute_damage(rows).items()}


def test_repair_drops_whole_conversation(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert got_repairs(repair.repair(repair.damage(df))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversation_takes_steps_in_proportion(spark):
    """A conversation of 30,000 turns; states are four at any time and strings are not compared."""
    paths = repair.Composition()
    for i in range(30000):
        paths.read("u" if i % 3 else "a", "user" if i % 3 else "assistant", "x.", repair.SOUND)
        assert len(paths.now) <= 4
    cost, labels, _ = paths.close()
    assert len(labels.replace("I", "")) == 30000 and cost > 0


# 12
def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, k=10):
    vectors = [(i, n, [math.floor(1024 * float(x)) for x in v]) for i, (n, v) in enumerate(rows) if n is not None and whole(v)]
    out = []
    for i, n, q in vectors:
        if n % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), m) for j, m, v in vectors if j != i)
            out += [(n, r + 1, m, -s) for r, (s, m) in enumerate(scored[:k])]
    return sorted(out)


def got_top(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_topk_odd_rows(spark, kind):
    draw = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=5)]) for i in range(0, 420)]
    rows += [(i, [0.5, 0.25, -0.125, 0.0, 1.0]) for i in range(420, 480)] + [(100, [1.0] * 5), (100, [1.0] * 5)]
    rows += [(500, None), (600, [1.0, None, 0.0, 0.0, 0.0]), (700, [math.nan] * 5), (800, [math.inf, 0.0]), (None, [9.0] * 5), (900, []), (1000, [2.0]), (-100, [1.0] * 7)]
    df = spark.createDataFrame([(n, v, 1, "x") for n, v in rows], f"vec_id long, embedding array<{kind}>, uid int, near string")
    want = brute_top(rows)
    assert got_top(topk.search(df)) == want
    assert got_top(topk.search(df, sample=20, block=16, query_block=2)) == want
    assert topk.search(df.limit(0)).count() == 0
    assert topk.search(df.where("vec_id % 100 = 1")).count() == 0


def test_topk_few_rows_and_large_values(spark):
    rows = [(0, [1e6, 2e6]), (1, [1e5, -1e5]), (2, [1e6, 3.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got_top(topk.search(df)) == brute_top(rows)
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="outside 64-bit"):
        topk.search(huge).collect()


def test_topk_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got_top(queries.op12_topk(spark, sf)) == brute_top(rows)


def test_topk_stops_early():
    """On clustered vectors most candidates are never scored, and the result is exact."""
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(20, 16)) * 4
    x = np.floor((centres[draw.integers(0, 20, 4000)] + draw.normal(size=(4000, 16)) * 0.05) * 1024)
    pivots = topk.choose_pivots(x[:500])
    scored = []
    block = topk.Candidates(np.arange(4000), np.arange(4000), x, topk.distances(x, pivots).astype(np.float32))
    real = topk.exact
    try:
        topk.exact = lambda rows, q: scored.append(len(rows)) or real(rows, q)
        at, scores = block.best(0, x[0], topk.distances(x[:1], pivots)[0].astype(np.float32), 10, None)
    finally:
        topk.exact = real
    want = sorted((-int(x[i] @ x[0]), i) for i in range(1, 4000))[:10]
    assert list(zip((-scores).tolist(), at.tolist(), strict=True)) == want
    assert sum(scored) < 2000


# 13
def fails(text, doc, texts):
    words = re.findall(SPACE + "+", text)
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    return out | ({"E"} if doc is not None and any(d is not None and d < doc for d in texts[text]) else set())


def brute_audit(docs, labels):
    texts = defaultdict(list)
    for d, t, _ in docs:
        texts[t or ""].append(d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for d, t, s in docs:
        parts[s or ""].append((d, fails(t or "", d, texts)))
    out = {}
    for part, rows in parts.items():
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left, gone = rows, []
            for step, letter in enumerate(order, 1):
                removed = [r for r in left if letter in r[1]]
                redundant = sum(letter in r[1] for r in gone)
                left, gone = [r for r in left if letter not in r[1]], gone + removed
                shapley[letter] += len(removed)
                out[part, order, step] = [len(left), len(removed), redundant, sum(r[1] == {letter} for r in rows), sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got_audit(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def audit_tables(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, text string, source string, mask int, part string, print int")
    return d, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, n int")


def test_audit_odd_rows(spark):
    prose = " ".join(f"w{i}" for i in range(250))
    docs = [(5, prose, "a"), (3, prose, "b"), (9, prose, None), (9, prose, ""), (None, prose, "a"), (None, prose, "a"), (3, prose, "b"), (1, None, "a"), (2, "", "c"), (4, " \t", "c")]
    docs += [(6, "long word " * 60000, "a"), (7, "AB cd #", "b"), (8, prose + " |", "b"), (10, prose + " |", None), (11, "é" * 50 + "A", "é"), (12, prose + "\x1c&", "c")]
    docs += [(100 + i, "copy of one text", "src" + str(i % 3)) for i in range(300)]
    labels = [(3, 1, 0), (3, 0, 1), (9, 1, None), (None, 1, 1), (6, 1, 1), (7, None, 1), (200, 1, 1), (9999, 1, 1)]
    d, l = audit_tables(spark, docs, labels)
    want = brute_audit(docs, labels)
    assert got_audit(interaction.audit(d, l)) == want
    # many ranges, so that copies of one text lie over several tasks
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got_audit(interaction.audit(d, l)) == want
        assert got_audit(interaction.audit(d, l.limit(0))) == brute_audit(docs, [])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert interaction.audit(d.limit(0), l).count() == 0


def test_audit_texts_with_one_fingerprint(spark, monkeypatch):
    """Texts are compared whole: with one fingerprint for all, results stay."""
    monkeypatch.setattr(interaction, "fingerprint", lambda text: interaction.F.lit(7).cast("long"))
    docs = [(i, f"text {i % 7}", "a") for i in range(200)]
    d, l = audit_tables(spark, docs, [(1, 1, 1)])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got_audit(interaction.audit(d, l)) == brute_audit(docs, [(1, 1, 1)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_audit_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got_audit(queries.op13_interaction(spark, sf)) == brute_audit(docs, labels)
