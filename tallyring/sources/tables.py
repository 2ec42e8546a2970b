"""Reading, writing and cutting lineage."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, in local mode, a local one, once an
    application; on a cluster, whose executors see no such folder, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tallyring-"))).rstrip("/")


def step(spark: SparkSession) -> str:
    """A new path of this application in the shared folder."""
    return f"{shared_folder(spark)}/tallyring/{spark.sparkContext.applicationId}/step-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and written; lost executors lose nothing of it."""
    path = step(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        files, own = _files(spark, path)
        files.delete(own, True)


class Parts:
    """Rows written once in parts by a column of small whole numbers; parts can be rewritten alone.
    New files are written beside the old ones, then take their place, then the old ones go."""

    def __init__(self, spark: SparkSession, schema: T.StructType, part: str, paths: dict[int, str], folder: str | None = None) -> None:
        self.spark, self.schema, self.part, self.paths, self.folder = spark, schema, part, paths, folder

    @classmethod
    def of(cls, df: DataFrame, part: str, folder: str | None = None) -> Parts:
        parts = cls(df.sparkSession, df.schema, part, {}, folder)
        parts.paths = parts.write(df)
        return parts

    def write(self, df: DataFrame) -> dict[int, str]:
        """Files of new rows, in the place of none yet."""
        path = f"{self.folder}/part-{uuid.uuid4().hex}" if self.folder else step(self.spark)
        # every row keeps the number, as the column that names folders is not in the files
        df.withColumn("__part", F.col(self.part)).write.partitionBy("__part").parquet(path)
        files, folder = _files(self.spark, path)
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return {int(n[7:]): f"{path}/{n}" for n in names if n.startswith("__part=")}

    def replace(self, parts: Sequence[int], new: dict[int, str]) -> list[str]:
        """Put files in the place of parts; the files that were there, which still are."""
        old = [self.paths.pop(k) for k in parts if k in self.paths]
        self.paths |= new
        return old

    def at(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def frame(self, parts: Sequence[int] | None = None) -> DataFrame:
        return self.at([p for k, p in sorted(self.paths.items()) if parts is None or k in parts])


class Manifest:
    """What a run in steps has finished, in a folder: one small file a step, whole or not there."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self) -> list[str]:
        files, own = _files(self.spark, self.folder)
        return [s.getPath().getName() for s in files.listStatus(own)] if files.exists(own) else []

    def _steps(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))

    def last(self) -> dict | None:
        steps = self._steps()
        if not steps:
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/manifest-{steps[-1]}.json", wholetext=True).first()[0])

    def commit(self, state: dict, done: int) -> None:
        """Keep the state after ``done`` steps; a file takes its name when it is whole."""
        older = self._steps()
        files, draft = _files(self.spark, f"{self.folder}/draft-{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not files.rename(draft, _files(self.spark, f"{self.folder}/manifest-{done}.json")[1]):
            raise OSError(f"step {done} is committed already")
        delete(self.spark, *[f"{self.folder}/manifest-{k}.json" for k in older if k < done])

    def clean(self, paths: Sequence[str]) -> None:
        """Delete what a run that ended early has left beside the committed files."""
        kept = {p.removeprefix(self.folder + "/").split("/")[0] for p in paths}
        delete(self.spark, *[f"{self.folder}/{n}" for n in self._names() if n.startswith(("part-", "draft-")) and n not in kept])


def read(spark: SparkSession, source: str) -> DataFrame:
    """A Parquet path, a catalogue table, or the text of a query, which may begin with comments or
    brackets."""
    text = source.strip()
    bare = re.sub(r"^(\s|\(|--[^\n]*(\n|$)|/\*.*?\*/)+", "", text, flags=re.S)
    if re.match(r"(select|with|values|from|table)\s*\b", bare, re.I) and re.search(r"\s|\(", bare):
        return spark.sql(text)
    return spark.read.parquet(text) if "/" in text or text.endswith(".parquet") else spark.table(text)


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """Rows of a pandas frame, NaN as null."""
    return nan_to_null(spark.createDataFrame(frame))


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType) and (columns is None or f.name in columns)]
    return df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in names}) if names else df


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
