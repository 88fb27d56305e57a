"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark from wherever ``sf_dir`` lives."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session of one machine may go without: it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        path = "file://" + tempfile.mkdtemp(prefix="tidecast-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, under: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` to a table in the shared folder, or in ``under``, and read it back.

    Lost executors cost nothing afterwards: every later read starts from the
    table, not from recomputation.
    """
    spark = df.sparkSession
    path = f"{(under or shared_dir(spark)).rstrip('/')}/tidecast-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder for the tables that an operator needs only until its result is written.

    ``keep`` writes such a table; ``result`` writes the operator's own rows
    beside the folder and then deletes it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/tidecast-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        return materialize(df, self.path)

    def result(self, df: DataFrame) -> DataFrame:
        out = materialize(df)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return out


#: Tables are broadcast up to so many bytes, as counted by ``small``; joined by a shuffle beyond it.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, *long: str) -> DataFrame:
    """``df`` with a hint to broadcast it if its bytes, 100 for a row besides its texts and arrays in the columns ``long``, are within the bound."""
    size = F.lit(0).cast("long")
    for c in long:
        column = F.col(f"`{c}`")
        column = F.size(column) * 40 if df.schema[c].dataType.typeName() == "array" else F.octet_length(column.cast("string"))
        size = size + F.coalesce(column, F.lit(0))
    (total,) = df.agg(F.count("*") * 100 + F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


#: Rows and bytes that a Python function gets at a time: rows hold whole texts.
PART_ROWS, PART_BYTES = 1000, 4 << 20


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to ``PART_ROWS`` rows and, where that takes more than one row, ``PART_BYTES`` bytes."""
    for batch in batches:
        todo = [batch.slice(at, PART_ROWS) for at in range(0, batch.num_rows, PART_ROWS)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > PART_BYTES:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and shares the executor's memory with the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` over small parts of the batches, so that a Python worker's memory is bounded, during the task and after it.

    Lowers the session's Arrow batch limits where they are larger: Spark holds
    a batch outside its heap, and Python all of it, before it can be cut.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= PART_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", PART_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", PART_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(parts(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def column_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty; nothing is decoded or copied on the way."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def set_aside(df: DataFrame, *names: str):
    """``df`` with its columns of these names renamed, and a function that gives a frame made from it the names back."""
    there = {n: fresh(df, f"own_{n}") for n in names if n in df.columns}
    return df.withColumnsRenamed(there), lambda out: out.withColumnsRenamed({v: k for k, v in there.items()})


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that an operator is about to produce itself."""
    return df.drop(*[c for c in df.columns if c in names])


def as_bytes(name: str = "text"):
    """A string column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """Smallest reachable id for every vertex of an undirected edge list.

    Alternates a neighbour-minimum step with pointer jumping, so the rounds
    grow with the logarithm of the longest path. All state stays distributed:
    the driver sees one count a round. Returns ``(id, component_id)``.
    """
    keep = scratch.keep if scratch else materialize
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    both = keep(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("m"))
        step = labels.join(near, "u").select("u", "c", F.least("c", "m").alias("n"))
        # hooking: what a vertex learned is told to the root it had before
        roots = step.groupBy(F.col("c").alias("r")).agg(F.min("n").alias("rm"))
        step = step.join(roots, step.c == roots.r).select("u", "c", F.least("n", "rm").alias("n"))
        step = keep(step)
        # pointer jumping: the label's own new label
        jump = step.select(F.col("u").alias("n"), F.col("n").alias("nn"))
        new = keep(step.join(jump, "n", "left").select("u", F.col("c").alias("old"), F.least("n", F.coalesce("nn", "n")).alias("c")))
        if new.where("old <> c").isEmpty():
            return new.select(F.col("u").alias("id"), F.col("c").alias("component_id"))
        labels = new.select("u", "c")
    raise RuntimeError("components did not settle")
