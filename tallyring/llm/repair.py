"""Repair of conversation structure by weighted finite-state composition.

The rows of a conversation are an input acceptor, a state a row. An edit transducer reads a row
and writes a turn: it keeps, reroles or deletes it, and may insert turns without text before it.
The acceptor of the role grammar ``(s?(ua)+)?`` reads what is written. Their composition is never
made: from the states that are reached (row, grammar state) only the arcs of the next row are made,
in topological order, with weights (cost, labels) compared first by cost, then by the label string.
Among paths that have read the same rows and end in a row's label, no label string begins another,
so their order is kept by whatever follows: a state needs its rank alone, not its string. Labels
are kept as one step back a row and state, and every state hashes what it has written as it goes. So a
conversation streams through its task in order, a few bytes a row, texts one batch at a time.

Damage and faults are columns: the rows of a conversation are shuffled once, sorted by (role, text)
for the rows seen before, and by turn for the repair.

Definitions
  nulls       a null role or text is one space, as is a null conv_id or turn in ``conv_id:turn``; rows
              of null conv_id are one conversation.
  order       by turn, nulls first, then by role and text as damaged; repeated rows stand together.
  initial     the first character of a role; an empty role has none and is never kept.
  faults      blank, duplicate, truncated, a row's first one alone; a duplicate has the role and text of
              any earlier row of its conversation.
  dropped     a conversation without rows after the damage has zeros, an empty audit and the hash of
              the empty string.
Columns beyond conv_id, turn, role and text are not read, whatever their names; an empty table
gives no rows. conv_id may have any type, turn must be a whole number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Faults of a row; -1 marks a row that the damage dropped.
DROPPED, SOUND, BLANK, DUPLICATE, TRUNCATED = -1, 0, 1, 2, 3
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS = 2, 3, 2, 1
#: The role grammar: next state by state and initial; START and ANSWERED accept.
START, SYSTEM, USER, ANSWERED = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ANSWERED, (ANSWERED, "u"): USER}
ACCEPTS = (START, ANSWERED)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")


def _insertions() -> dict[int, list[tuple[int, list[str]]]]:
    """From every grammar state, the states that insertions reach, each once, with what they write.

    A path that comes to a state again costs more and changes nothing, so it is no part of a
    shortest one."""
    out = {}
    for start in range(4):
        paths, ends = [(start, [])], {start}
        for state, written in paths:
            for initial, role in ROLES.items():
                to = GRAMMAR.get((state, initial))
                if to is not None and to not in ends:
                    ends.add(to)
                    paths.append((to, [*written, role]))
        out[start] = paths
    return out


INSERTIONS = _insertions()


class Composition:
    """The best path to each grammar state after the rows read so far."""

    def __init__(self) -> None:
        # state: cost, rank among the states' label strings, hash of what is written
        self.now: dict[int, tuple[int, int, object]] = {START: (0, 0, hashlib.sha256())}
        #: a row's steps back: state to (state before, labels)
        self.back: list[dict[int, tuple[int, str]]] = []

    def read(self, initial: str, role: str, text: str, fault: int) -> None:
        """All arcs of the next row from the states reached."""
        best: dict[int, tuple] = {}
        gone = fault in (BLANK, DUPLICATE)
        stays = STAYS if fault == TRUNCATED else 0
        for state, (cost, rank, _) in self.now.items():
            for at, added in INSERTIONS[state]:
                paid, labels = cost + INSERT * len(added), "I" * len(added)
                arcs = [(at, paid + DELETE, labels + "D", None)]
                if not gone:
                    if (at, initial) in GRAMMAR:
                        arcs.append((GRAMMAR[at, initial], paid + stays, labels + "K", role))
                    for i, other in ROLES.items():
                        if (at, i) in GRAMMAR:
                            arcs.append((GRAMMAR[at, i], paid + REROLE + stays, labels + "R", other))
                for to, total, label, wrote in arcs:
                    path = (total, rank, label, state, added, wrote)
                    if to not in best or path[:3] < best[to][:3]:
                        best[to] = path
        ranks = {k: i for i, k in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        line, after, steps = None, {}, {}
        for to, (total, _, label, state, added, wrote) in best.items():
            written = self.now[state][2]
            if added or wrote is not None:
                written, first = written.copy(), state == START
                for other in added:
                    written.update((b"" if first else b"\n") + f"{other}:".encode())
                    first = False
                if wrote is not None:
                    if line is None:
                        line = text.encode()
                    written.update((b"" if first else b"\n") + f"{wrote}:".encode())
                    written.update(line)
            after[to] = (total, ranks[to], written)
            steps[to] = (state, label)
        self.now = after
        self.back.append(steps)

    def close(self) -> tuple[int, str, str]:
        """Cost, labels and hash of the shortest path that the grammar accepts."""
        ends = [(cost + INSERT * len(added), rank, "I" * len(added), state, added) for state, (cost, rank, _) in self.now.items() for at, added in INSERTIONS[state] if at in ACCEPTS]
        cost, _, label, state, added = min(ends, key=lambda e: e[:3])
        written, first = self.now[state][2].copy(), state == START
        for other in added:
            written.update((b"" if first else b"\n") + f"{other}:".encode())
            first = False
        labels = [label]
        for steps in reversed(self.back):
            state, label = steps[state]
            labels.append(label)
        return cost, "".join(reversed(labels)), written.hexdigest()


class _Conversation:
    """Counts and repair of one conversation, row by row."""

    def __init__(self, key) -> None:
        self.key, self.paths = key, Composition()
        self.turns, self.first, self.last, self.illegal, self.before = 0, None, None, 0, None
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault == DROPPED:
            return
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.faults[fault] += 1
        self.paths.read(initial, role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, labels, digest = self.paths.close()
        return (self.key, gaps, *self.faults[1:], self.illegal, cost, labels, digest)


_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_TYPES = [*[pa.int64()] * 6, pa.string(), pa.string()]


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, kind, out, size = None, None, [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, *_TYPES], strict=True)], names=_NAMES)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for key, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")], strict=True):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.row())
                    size += len(out[-1][-2]) + 200
                    if size > 1 << 20:
                        yield done()
                        out, size = [], 0
                now = _Conversation(key)
            now.add(*row)
    if now is not None:
        out.append(now.row())
        yield done()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of the rows as the fixed rule damages them; dropped rows
    stay, marked, so that their conversation is known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(key), F.lit(20)).alias("harm"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("harm") == 4, "user").otherwise(F.col("role")), "dropped": F.col("harm") == 0})
    return rows.select("conv_id", "turn", "role", "text", "dropped", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def fault(text: str, seen: Column) -> Column:
    """The first fault of a row."""
    bare = F.regexp_extract(text, "([^ \\t-\\r])[ \\t-\\r]*\\z", 1)
    return F.when(bare == "", BLANK).when(seen, DUPLICATE).when(~bare.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)


def repair(rows: DataFrame) -> DataFrame:
    """A row a conversation of ``rows`` (conv_id, turn, role, text, dropped): gaps, blank, duplicate,
    truncated, illegal, cost, audit and repaired_sha256."""
    # one shuffle by conversation serves the window and the repair
    met = rows.select("conv_id", "turn", "role", "text", "dropped").repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    found = met.withColumn("seen", earlier)
    found = found.select("conv_id", "turn", "role", "text", F.when(F.col("dropped"), DROPPED).otherwise(fault("text", F.col("seen"))).cast("int").alias("fault"), "seen")
    # among equal rows the one not seen before comes first
    ordered = found.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen").drop("seen")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_repair, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


#: Rows are damaged and judged, then paths grow row by row, the least (cost, audit) of each last initial kept.
ORACLE_SQL = r"""
WITH RECURSIVE
bytes AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_concat([b], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),
raw AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
harmed AS (
  SELECT raw.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
                                lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) % 20 AS harm FROM raw, bytes),
damaged AS (
  SELECT k, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy FROM harmed WHERE harm <> 0),
met AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS bare FROM damaged),
rows AS (
  SELECT k, turn, role, text, role[1] AS x,
         CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN bare NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         row_number() OVER w AS i, lag(role[1]) OVER w AS prior
  FROM met WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, seen)),
counts AS (
  SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || x NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY k),
added(g, here, ii, lines) AS (
  VALUES ('b', 'b', '', []::VARCHAR[]), ('b', 'u', 'I', ['user:']), ('b', 'a', 'II', ['user:', 'assistant:']), ('s', 's', '', []), ('s', 'u', 'I', ['user:']),
         ('s', 'a', 'II', ['user:', 'assistant:']), ('u', 'u', '', []), ('u', 'a', 'I', ['assistant:']), ('a', 'a', '', []), ('a', 'u', 'I', ['user:'])),
edits(e, dest, name) AS (VALUES ('D', NULL, NULL), ('K', NULL, NULL), ('R', 'u', 'user'), ('R', 'a', 'assistant')),
paths AS (
  SELECT DISTINCT k, 0::BIGINT AS i, 'b' AS g, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS p FROM raw
  UNION ALL
  SELECT k, i, g, min(p) AS p FROM (
    SELECT q.k, r.i, CASE e WHEN 'D' THEN here WHEN 'K' THEN r.x ELSE dest END AS g,
           {'cost': q.p.cost + 2 * len(ii) + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END,
            'audit': q.p.audit || ii || e,
            'lines': list_concat(list_concat(q.p.lines, added.lines), CASE e WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [name || ':' || r.text] END)} AS p
    FROM paths q JOIN rows r ON r.k = q.k AND r.i = q.i + 1 JOIN added ON added.g = q.g CROSS JOIN edits
    WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND here || CASE e WHEN 'K' THEN r.x ELSE dest END IN ('bs', 'bu', 'su', 'ua', 'au'))
  GROUP BY k, i, g),
ends AS (
  SELECT q.k, min({'cost': q.p.cost + 2 * len(ii), 'audit': q.p.audit || ii, 'lines': list_concat(q.p.lines, added.lines)}) AS p
  FROM paths q LEFT JOIN counts c ON c.k = q.k JOIN added ON added.g = q.g WHERE q.i = coalesce(c.n, 0) AND here IN ('b', 'a') GROUP BY q.k)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, p.cost::BIGINT AS cost, p.audit AS audit,
       sha256(array_to_string(p.lines, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM raw) o JOIN ends USING (k) LEFT JOIN counts USING (k)
"""
