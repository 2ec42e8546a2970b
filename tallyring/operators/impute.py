"""Imputation by chained equations over shared aggregates.

Rows carry a mask with a bit for each nullable column that is missing in them. A column
learns from the rows where it is observed and not every nullable column is missing; its
missing values are then predicted. What is kept on the driver is one aggregate a nullable column and
one more, whatever patterns of gaps occur:

  baseline  keeps none and sums the training rows of each column from scratch;
  low       (few missing) keeps the sum of all rows, and of the rows that miss each column, which
            is taken off;
  high      (many missing) keeps the sum of complete rows, and of the rows with gaps that have
            each column, which is added.

Rows count towards the aggregates of several columns, so each is taken once for every bit that is
set (or clear) in one aggregation. When a column has been imputed, the rows that missed it
are summed as they were and as they are, and the differences move the aggregates.

All three learn from the same rows and so agree up to rounding. Categorical columns are
predicted by linear discriminants, continuous ones by least squares; categorical columns
come first.

Rows are written once, in parts by what they lack: nothing, one column alone (a part each), or
more. A step reads and rewrites the part of its column and the last one only, so rows without
gaps are written once; files that a step replaces are deleted. Neither lineage nor expressions
grow, and random noise is drawn once. With a folder of its own (``work``) a run commits every step
there; a run that was lost is taken up again after its last step.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyring.operators.models import LDA, LinearRegression
from tallyring.operators.ring import Cofactor
from tallyring.plans import aggregate
from tallyring.plans.aggregate import Spec
from tallyring.sources.tables import Manifest, Parts, delete, read

STRATEGIES = ("baseline", "low", "high")
MASK, PART = "null_mask", "null_part"


def flag(column: str) -> str:
    return f"{column}_ISNULL"


def null_mask(nullable: Sequence[str]) -> Column:
    bits = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(nullable)]
    return reduce(lambda a, b: a + b, bits, F.lit(0)).cast("long")


def partitioned(df: DataFrame, nullable: Sequence[str]) -> DataFrame:
    """``df`` with a flag a nullable column, the mask, how many are missing (null_cnt), and which
    one if it is one alone (null_col_id, its place from 1; else null)."""
    if len(nullable) > 62:
        raise ValueError("at most 62 nullable columns")
    out = df.withColumns({flag(c): F.col(c).isNull() for c in nullable}).withColumn(MASK, null_mask(nullable))
    alone = reduce(lambda w, ic: w.when(F.col(MASK) == F.lit(1 << ic[0]), F.lit(ic[0] + 1)), enumerate(nullable), F.when(F.lit(False), F.lit(0)))
    return out.withColumn("null_cnt", F.bit_count(MASK)).withColumn("null_col_id", alone)


def layout(df: DataFrame, nullable: Sequence[str], strategy: str = "low") -> DataFrame:
    """The output layout of the strategies: every column, ``row_id`` (unique), and of ``baseline`` a
    flag a nullable column (c_ISNULL); of ``low`` also how many are missing (null_cnt) and which one
    alone (null_col_id, from 1; 0 for none, null for several); of ``high`` the same told of what is
    there: c_ISNOTNULL, not_null_cnt and not_null_col_id."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    return _laid_out(df, nullable, [F.col(c).isNull() for c in nullable], strategy)


def _laid_out(df: DataFrame, nullable: Sequence[str], missing: Sequence[Column], strategy: str) -> DataFrame:
    out = df.withColumn("row_id", F.monotonically_increasing_id())
    wanted, said, count, which = (missing, "ISNULL", "null_cnt", "null_col_id") if strategy != "high" else ([~m for m in missing], "ISNOTNULL", "not_null_cnt", "not_null_col_id")
    flags = {f"{c}_{said}": w for c, w in zip(nullable, wanted, strict=True)}
    if strategy == "baseline":
        return out.withColumns(flags)
    total = reduce(lambda a, b: a + b, [w.cast("int") for w in wanted], F.lit(0))
    alone = reduce(lambda a, iw: a.when((total == 1) & iw[1], F.lit(iw[0] + 1)), enumerate(wanted), F.when(total == 0, F.lit(0)))
    return out.withColumns(flags | {count: total, which: alone})


def initial_values(df: DataFrame, cont: Sequence[str], cat: Sequence[str]) -> dict:
    """Mean of each continuous and mode (smallest of ties) of each categorical column, all rows."""
    if not cont and not cat:
        return {}
    out = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cont]).first().asDict() if cont else {}
    for c in cat:
        first = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        out[c] = first[0] if first else None
    return out


def fill(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None}) if values else df


@dataclass
class Imputed:
    """``frame`` keeps all input columns, filled, with flags and mask; ``trace`` has a row a step."""

    frame: DataFrame
    trace: list[dict] = field(default_factory=list)


class _Sums:
    """The aggregates of a strategy, by column and, under WHOLE, of all rows or of the complete ones."""

    WHOLE = -1

    def __init__(self, strategy: str, spec: Spec, nullable: Sequence[str], full: int | None, about: dict[str, float]) -> None:
        self.strategy, self.spec, self.full, self.about = strategy, spec, full, about
        self.held: dict[int, Cofactor] = {}
        bit = [F.col(MASK).bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(nullable))]
        if strategy == "low":
            self.of = F.array_compact(F.array(F.lit(self.WHOLE), *[F.when(b, F.lit(i)) for i, b in enumerate(bit)]))
        else:
            self.of = F.when(F.col(MASK) == 0, F.array(F.lit(self.WHOLE))).otherwise(F.array_compact(F.array(*[F.when(~b, F.lit(i)) for i, b in enumerate(bit)])))

    def _sums(self, rows: DataFrame, *by: str) -> dict[tuple, Cofactor]:
        """Aggregates of rows by column and ``by``: as many as there are columns, not patterns."""
        used = rows if self.full is None else rows.where(F.col(MASK) != self.full)
        return aggregate.cofactors(used.withColumn("__of", F.explode(self.of)), self.spec, ["__of", *by], self.about)

    def take(self, rows: DataFrame) -> None:
        self.held = {k: a for (k,), a in self._sums(rows).items()}

    def move(self, old: DataFrame, new: DataFrame, bit: int) -> None:
        """Put rows that missed a column, as they are, in the place of what they were."""
        missed = lambda rows, side: rows.where(F.col(MASK).bitwiseAND(F.lit(bit)) != 0).withColumn("__side", F.lit(side))
        for (k, side), a in self._sums(missed(old, -1).unionByName(missed(new, 1)), "__side").items():
            self.held[k] = self.held[k] + a if side > 0 else self.held[k] - a

    def training(self, column: int) -> Cofactor | None:
        whole, own = self.held.get(self.WHOLE), self.held.get(column)
        if whole is None or own is None:
            found = whole if self.strategy == "low" or own is None else own
        else:
            found = whole - own if self.strategy == "low" else whole + own
        return found.prune() if found is not None and found.count else None


def _from_scratch(parts: Parts, column: int, spec: Spec, bit: int, full: int | None, about: dict[str, float]) -> Cofactor | None:
    rows = parts.frame([k for k in parts.paths if k != column]).where(F.col(MASK).bitwiseAND(F.lit(bit)) == 0)
    return aggregate.cofactors(rows if full is None else rows.where(F.col(MASK) != full), spec, [], about).get(())


def impute(df: DataFrame, cont: Sequence[str] = (), cat: Sequence[str] = (), cont_null: Sequence[str] = (), cat_null: Sequence[str] = (), *, iterations: int = 2, strategy: str = "low", noise_seed: int | None = None, decimal: tuple[int, int] | None = None, work: str | None = None) -> Imputed:
    """Fill ``cont_null`` and ``cat_null`` (parts of ``cont`` and ``cat``); other columns stay.

    A column without any observed value in rows that may train keeps its initial value, and
    null if it has none at all. ``noise_seed`` adds normal noise of the residual deviation. ``work``
    names a shared folder for this run alone: called again with it, a run goes on after the last step
    that was committed there, or gives the result if all were."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    nullable = [*cat_null, *cont_null]
    if unknown := {*cont_null} - {*cont} | {*cat_null} - {*cat}:
        raise ValueError(f"nullable columns that are no features: {sorted(unknown)}")
    start = time.perf_counter()
    typed = df.withColumns({c: F.col(c).cast("double") for c in cont}) if cont else df
    marked, several = partitioned(typed, nullable), len(nullable) + 1
    whole = marked.withColumn(PART, F.when(F.col("null_cnt") == 0, 0).when(F.col("null_cnt") == 1, F.col("null_col_id")).otherwise(several).cast("int"))
    asked = {"cont": [*cont], "cat": [*cat], "nullable": nullable, "iterations": iterations, "strategy": strategy, "seed": noise_seed, "decimal": list(decimal or ()), "columns": [f.simpleString() for f in whole.schema.fields]}
    manifest = Manifest(df.sparkSession, work) if work else None
    state = manifest.last() if manifest else None
    if state is not None:
        if state["asked"] != asked:
            raise ValueError(f"{work} holds another run")
        parts = Parts(df.sparkSession, whole.schema, PART, {int(k): p for k, p in state["paths"].items()}, manifest.folder)
        manifest.clean(list(parts.paths.values()))
    else:
        values = initial_values(df, cont_null, cat_null)
        parts = Parts.of(fill(whole, values), PART, manifest.folder if manifest else None)
        trace = [{"iteration": 0, "column": None, "phase": "fill", "ms": 1000 * (time.perf_counter() - start)}]
        usable = [c for c in nullable if values.get(c) is not None]
        kept = [c for c in cont if c not in nullable or c in usable]
        state = {"asked": asked, "usable": usable, "about": aggregate.shifts(typed, kept), "trace": trace, "done": 0}
        _commit(manifest, state, parts)
    usable, about = state["usable"], state["about"]
    spec = Spec(tuple(c for c in cont if c not in nullable or c in usable), tuple(c for c in cat if c not in nullable or c in usable), decimal)
    full = (1 << len(nullable)) - 1 if len(nullable) > 1 else None
    steps = [(i, c) for i in range(1, iterations + 1) for c in usable]
    sums = _Sums(strategy, spec, nullable, full, about) if strategy != "baseline" and state["done"] < len(steps) else None
    if sums is not None:
        sums.take(parts.frame())
    for i, c in steps[state["done"] :]:
        start, column = time.perf_counter(), nullable.index(c)
        bit, own = 1 << column, [column + 1, several]
        a = sums.training(column) if sums is not None else _from_scratch(parts, column + 1, spec, bit, full, about)
        state["done"] += 1
        if a is None:
            continue
        if c in cat_null:
            predicted = LDA.fit(a, c).predict_column()
        else:
            model = LinearRegression.fit(a, c, variance=noise_seed is not None)
            predicted = model.predict_column(None if noise_seed is None else noise_seed + 1000 * i + column)
        trained = time.perf_counter()
        old = parts.frame(own)
        new = parts.write(old.withColumn(c, F.when(F.col(flag(c)), predicted.cast(parts.schema[c].dataType)).otherwise(F.col(c))))
        if sums is not None and state["done"] < len(steps):
            sums.move(old, parts.at(list(new.values())), bit)
        state["trace"].append({"iteration": i, "column": c, "phase": "train", "ms": 1000 * (trained - start)})
        state["trace"].append({"iteration": i, "column": c, "phase": "impute", "ms": 1000 * (time.perf_counter() - trained)})
        gone = parts.replace(own, new)
        _commit(manifest, state, parts)
        delete(df.sparkSession, *gone)
    return Imputed(parts.frame().drop(PART), state["trace"])


def impute_table(spark: SparkSession, source: str, target: str, cont: Sequence[str] = (), cat: Sequence[str] = (), cont_null: Sequence[str] = (), cat_null: Sequence[str] = (), *, strategy: str = "low", mode: str = "errorifexists", **options) -> list[dict]:
    """Fill a table, path or query and write the result in the strategy's layout (:func:`layout`) as a
    table of the catalogue, or as a path if ``target`` is one; the steps' trace."""
    found = impute(read(spark, source), cont, cat, cont_null, cat_null, strategy=strategy, **options)
    nullable = [*cat_null, *cont_null]
    bare = found.frame.drop(*[flag(c) for c in nullable], "null_cnt", "null_col_id")
    out = _laid_out(bare, nullable, [F.col(MASK).bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(nullable))], strategy).drop(MASK)
    writer = out.write.mode(mode)
    if "/" in target:
        writer.parquet(target)
    else:
        writer.saveAsTable(target)
    return found.trace


def _commit(manifest: Manifest | None, state: dict, parts: Parts) -> None:
    if manifest is not None:
        manifest.commit(state | {"paths": parts.paths}, state["done"])
