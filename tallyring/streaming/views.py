"""Sums over a join tree, kept up to date as its tables change.

For every table two things are stored: its own sums by its keys and categories, and the
sums over the tree below it by the key that leads up (for a table with none below, these are its own,
stored once). A change (rows that come, or go, with
sign -1) is summed by key; it multiplies with the stored sums of the tables below, and so on to the
root with those of the tables beside the way. Only keys that the change touches are multiplied.
Subtraction is the ring's, so deletions need no other way.

Every step appends its differences as files of its own, named by its number: a step that is run again
(as a lost micro-batch is) writes them anew and nothing counts twice. Stored sums are the sums
of differences; ``compact`` writes them as one. ``follow`` takes the changes from a stream.

Rules for nulls are those of :mod:`tallyring.plans.factorized`; features may have fixed shifts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyring.operators.ring import Cofactor
from tallyring.plans.factorized import Table, _columns, _local, _multiply, _Sums, collected


class Views:
    """``tree`` names tables by the order of its nodes (a table, then those below its first child, ...);
    its DataFrames give schemas alone, rows come by :meth:`change`."""

    def __init__(self, spark: SparkSession, tree: Table, folder: str, shifts: Mapping[str, float] | None = None) -> None:
        self.spark, self.folder, self.shifts = spark, folder.rstrip("/"), dict(shifts or {})
        self.nodes: list[Table] = []
        self.above: list[tuple[int, str, str] | None] = []
        self._walk(tree, None)
        self.below = [[(k, o, j) for j, up in enumerate(self.above) if up and up[0] == i for k, o in [up[1:]]] for i in range(len(self.nodes))]
        self.step = -1

    def _walk(self, t: Table, above: tuple[int, str, str] | None) -> None:
        own = len(self.nodes)
        self.nodes.append(t)
        self.above.append(above)
        for key, other, child in t.children:
            self._walk(child, (own, key, other))

    def _keys(self, i: int) -> list[str]:
        up = [self.above[i][2]] if self.above[i] else []
        return list(dict.fromkeys([*up, *[k for k, _, _ in self.below[i]]]))

    def _up(self, i: int) -> list[str]:
        return [self.above[i][2]] if self.above[i] else []

    def _features(self, i: int, whole: bool) -> tuple[list[str], list[str]]:
        """Features of a table, or of the tree below it, in the order in which products take them."""
        cont, cat = list(self.nodes[i].cont), list(self.nodes[i].cat)
        for _, _, j in self.below[i] if whole else ():
            more = self._features(j, True)
            cont, cat = cont + more[0], cat + more[1]
        return cont, cat

    def _path(self, kind: str, i: int) -> str:
        return f"{self.folder}/{kind}-{i}"

    def _write(self, kind: str, i: int, sums: _Sums) -> None:
        sums.rows.write.mode("overwrite").parquet(f"{self._path(kind, i)}/step={self.step}")

    def _kind(self, kind: str, i: int) -> str:
        return kind if self.below[i] else "local"

    def _read(self, kind: str, i: int, upto: int) -> _Sums | None:
        """Stored sums from the steps before ``upto``; none if there are none."""
        kind = self._kind(kind, i)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(kind, i))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        cont, cat = self._features(i, kind == "view")
        rows = self.spark.read.parquet(self._path(kind, i)).where(F.col("step") < upto)
        by = [c for c in rows.columns if c.startswith(("k__", "g__"))]
        # dealt by the key of the product that follows, they are summed and joined where they lie
        key = self.below[i][0][0] if kind == "local" and self.below[i] else next(iter(self._up(i)), None)
        rows = rows.repartition(f"k__{key}") if key else rows
        return _Sums(cont, cat, rows.groupBy(*by, "m").agg(*[F.sum(c).alias(c) for c in ("c", *_columns(cont))]))

    def _product(self, i: int, now: _Sums, given: dict[int, _Sums]) -> _Sums | None:
        """Sums of table i with those of the tables below, by the key that leads up."""
        for n, (key, other, j) in enumerate(self.below[i]):
            below = given.get(j) or self._read("view", j, self.step)
            if below is None:
                return None
            still = list(dict.fromkeys([*self._up(i), *[k for k, _, _ in self.below[i][n + 1 :]]]))
            now = _multiply(now, below, key, other, still)
        return now

    def change(self, table: int, rows: DataFrame, sign: int = 1, step: int | None = None) -> None:
        """Rows that come into a table (sign 1) or go (-1). ``step``: the change's number, higher than
        those before; the same number again replaces what it wrote. Without it the next is taken."""
        self.step = self.step + 1 if step is None else step
        t = self.nodes[table]
        own = _local(Table(rows, t.cont, t.cat, t.on_null), self._keys(table), self.shifts)
        signed = [F.col(c) if c not in ("c", *_columns(own.cont)) else (sign * F.col(c)).alias(c) for c in own.rows.columns]
        self._write("local", table, _Sums(own.cont, own.cat, own.rows.select(*signed)))
        delta = _Sums(own.cont, own.cat, self.spark.read.parquet(f"{self._path('local', table)}/step={self.step}"))
        now, i = self._product(table, delta, {}), table
        while now is not None:
            if self.below[i]:
                self._write("view", i, now)
            if self.above[i] is None:
                return
            up = self.above[i][0]
            changed = _Sums(now.cont, now.cat, self.spark.read.parquet(f"{self._path(self._kind('view', i), i)}/step={self.step}"))
            beside = self._read("local", up, self.step)
            now, i = (self._product(up, beside, {i: changed}) if beside is not None else None), up

    def touched(self, step: int | None = None) -> int:
        """Rows of sums that a step has written, in all tables."""
        step = self.step if step is None else step
        total = 0
        for kind in ("local", "view"):
            for i in range(len(self.nodes)):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(kind, i)}/step={step}")
                if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
                    total += self.spark.read.parquet(path.toString()).count()
        return total

    def root(self) -> Cofactor | None:
        """SUM over the join as it is now."""
        found = self._read("view", 0, self.step + 1)
        return collected(found, self.shifts) if found is not None else None

    def compact(self) -> None:
        """Write every stored sum as one, without those that have come to nothing, and delete the
        steps it stands for. It counts as a step."""
        self.step += 1
        for kind in ("local", "view"):
            for i in range(len(self.nodes)):
                whole = self._read(kind, i, self.step) if kind == self._kind(kind, i) else None
                if whole is None:
                    continue
                self._write(kind, i, _Sums(whole.cont, whole.cat, whole.rows.where("c <> 0")))
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(kind, i))
                files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
                for status in files.listStatus(folder):
                    name = status.getPath().getName()
                    if name.startswith("step=") and int(name[5:]) < self.step:
                        files.delete(status.getPath(), True)

    def follow(self, stream: DataFrame, table: int, sign: str, checkpoint: str, first: int = 0) -> StreamingQuery:
        """Take the changes of a table from a stream whose column ``sign`` is 1 or -1. Micro-batch b is
        steps ``first + 2 * b`` and the next."""

        def take(batch: DataFrame, number: int) -> None:
            for k, s in enumerate((1, -1)):
                self.change(table, batch.where(F.col(sign) == s).drop(sign), s, first + 2 * number + k)

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
