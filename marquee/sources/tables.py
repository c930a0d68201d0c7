"""Reading, building and appending tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions import literal_date, literal_stamp
from marquee.schema import NOW, TABLES


def read_table(
    spark: SparkSession, directory: str, name: str, schema: str | None = None
) -> DataFrame:
    """A stored table with its declared columns; nothing is inferred."""
    return spark.read.schema(schema or TABLES[name].ddl).parquet(f"{directory}/{name}.parquet")


def values_df(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """Literal rows as a relation with named, typed columns, nulls included."""
    fields = T.StructType.fromDDL(schema)
    literals = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*literals)))


def days_between(start: Column, end: Column) -> Column:
    """Every date from start to end, both included, as an array."""
    return F.sequence(start, end, F.expr("INTERVAL '1' DAY"))


def date_series(spark: SparkSession, start: str | date, end: str | date) -> DataFrame:
    """One row per day, both ends included."""
    days = days_between(literal_date(start), literal_date(end))
    return spark.range(1).select(F.explode(days).alias("day"))


def conform(df: DataFrame, table: str, now: str) -> DataFrame:
    """Bring rows to the declared table: missing columns added, defaults applied, types cast."""
    spec = TABLES[table]
    out = []
    for name, kind in spec.columns.items():
        value = F.col(name) if name in df.columns else F.lit(None)
        value = value.cast(kind)
        if name in spec.defaults:
            default = spec.defaults[name]
            fill = literal_stamp(now) if default is NOW else F.lit(default)
            value = F.coalesce(value, fill.cast(kind))
        out.append(value.alias(name))
    return df.select(*out)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a stored table."""
    df.write.mode("append").parquet(path)


def _commits(spark: SparkSession, path: str):
    """(Hadoop's file system, path class, the folder of commits) of a table that batches are added to."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{path.rstrip('/')}/_commits")
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop, folder


def append_once(df: DataFrame, path: str, batch: str) -> bool:
    """Add the rows of a batch to a table, once for each batch id; False if it is there already.

    The rows are written to a folder of their own that nobody reads yet.  The commit is a file that
    is named after the batch and holds the name of that folder; it is put in its place by a rename,
    which does not replace a file that is there.  A job that fails leaves a folder without commit, and
    a repeated job finds the commit and adds nothing.  Read with :func:`read_appended`.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"no name for a batch: {batch!r}")
    system, hadoop, folder = _commits(df.sparkSession, path)
    commit = hadoop(folder, batch)
    if system.exists(commit):
        return False
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    system.mkdirs(folder)
    draft = hadoop(folder, f".{name}")
    out = system.create(draft, False)
    out.write(bytearray(name.encode()))
    out.close()
    if system.exists(commit):  # another run of the job was faster
        system.delete(draft, False)
        return False
    return bool(system.rename(draft, commit))


def read_appended(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of all committed batches."""
    system, _, folder = _commits(spark, path)
    names = []
    if system.exists(folder):
        for status in system.listStatus(folder):
            if not status.getPath().getName().startswith("."):
                stream = system.open(status.getPath())
                names.append(bytes(stream.readAllBytes()).decode())
                stream.close()
    folders = [f"{path.rstrip('/')}/{name}" for name in sorted(names)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
