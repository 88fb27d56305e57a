"""A store of releases: rows are added as vintages with where they came from, and never edited.

A release is written in two phases. Its rows go to a folder of their own, which
no reader looks at; then one small file in the log names the folder and the
release's source, file, digest and notes. That file is renamed into place, and
an existing one is never replaced, so of two writers one takes the next number
and the other tries the one after. A release whose log file isn't there doesn't
exist, whatever an interrupted write has left.

Everything goes through Spark's readers and writers and the file system that the
store's path names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "indicator string, t long, value double"
LOG = "number long, vintage string, source string, file string, sha256 string, notes string, folder string, n long"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, store: str) -> list[int]:
    fs, log = _fs(spark, f"{store}/log")
    if not fs.exists(log):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(log)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def stage(rows: DataFrame, store: str) -> tuple[str, int]:
    """Write a release's rows where no reader looks: the folder's name and the number of rows. The first phase."""
    folder = f"rows-{uuid.uuid4().hex}"
    rows.select(F.col("indicator").cast("string"), F.col("t").cast("long"), F.col("value").cast("double")).write.parquet(f"{store}/{folder}")
    return folder, rows.sparkSession.read.schema(ROWS).parquet(f"{store}/{folder}").count()


def commit(spark: SparkSession, store: str, folder: str, n: int, vintage: str, source: str, file: str, sha256: str, notes: str = "", attempts: int = 100) -> int:
    """Make a staged release exist: its number in the log. The second phase."""
    entry = {"vintage": vintage, "source": source, "file": file, "sha256": sha256, "notes": notes, "folder": folder, "n": n}
    fs, log = _fs(spark, f"{store}/log")
    fs.mkdirs(log)
    for _ in range(attempts):
        number = max(_numbers(spark, store), default=0) + 1
        target = f"{store}/log/{number:010d}.json"
        draft = f"{store}/log/.draft-{uuid.uuid4().hex}"
        _put(spark, draft, json.dumps({"number": number, **entry}))
        _, at = _fs(spark, target)
        _, old = _fs(spark, draft)
        if not fs.exists(at) and fs.rename(old, at):
            return number
        fs.delete(old, False)  # another writer took the number
    raise RuntimeError(f"{store}: no free number in {attempts} attempts")


def publish(rows: DataFrame, store: str, vintage: str, source: str, file: str, sha256: str, notes: str = "") -> int:
    """Add ``rows`` (indicator, t, value) as a release. A re-release is a vintage of its own, even with equal rows."""
    folder, n = stage(rows, store)
    return commit(rows.sparkSession, store, folder, n, vintage, source, file, sha256, notes)


def releases(spark: SparkSession, store: str) -> DataFrame:
    """The log: a row for each release, in ``number``; none for an empty store."""
    if not _numbers(spark, store):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{store}/log/*.json")


def read_as_of(spark: SparkSession, store: str, vintage: str | None = None) -> DataFrame:
    """(indicator, t, value, vintage, number, source, file, sha256, notes): of every step the newest release up to ``vintage``.

    Vintages are texts that sort by time; of releases with one vintage the one
    with the larger number is newer. A value that a later release sets to null
    is null. Without ``vintage`` all releases count.
    """
    known = releases(spark, store)
    if vintage is not None:
        known = known.where(F.col("vintage") <= vintage)
    folders = [r.folder for r in known.select("folder").collect()]  # a row for each release
    rows = spark.read.schema(ROWS).parquet(*[f"{store}/{f}" for f in folders]) if folders else spark.createDataFrame([], ROWS)
    rows = rows.withColumn("folder", F.regexp_extract(F.input_file_name(), r"(rows-[0-9a-f]{32})/[^/]*$", 1))
    newest = rows.join(known, "folder").groupBy("indicator", "t").agg(F.max_by(F.struct("value", "vintage", "number", "source", "file", "sha256", "notes"), F.struct("vintage", "number")).alias("r"))
    return newest.select("indicator", "t", "r.*")


def history(spark: SparkSession, store: str) -> DataFrame:
    """(indicator, t, value, vintage, number) of every row of every release, for :func:`tidecast.operators.series.revisions`."""
    known = releases(spark, store)
    folders = [r.folder for r in known.select("folder").collect()]
    rows = spark.read.schema(ROWS).parquet(*[f"{store}/{f}" for f in folders]) if folders else spark.createDataFrame([], ROWS)
    rows = rows.withColumn("folder", F.regexp_extract(F.input_file_name(), r"(rows-[0-9a-f]{32})/[^/]*$", 1))
    return rows.join(known, "folder").select("indicator", "t", "value", "vintage", "number")
