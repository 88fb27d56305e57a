"""Audits, manifests and reports."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(df: DataFrame, name: str, content: str) -> DataFrame:
    """(file, bytes, sha256) of a content column, text or binary, with a name for each row; null content is empty."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return df.select(F.col(name).cast("string").alias("file"), F.length(data).cast("long").alias("bytes"), F.sha2(data, 256).alias("sha256"))


#: Bytes of a file that are held at a time.
PIECE = 1 << 20


def _opener(scheme: str):
    """A function that opens a path of this scheme on any machine, in pieces; None where only Spark can read it."""
    from pyarrow import fs

    if scheme in ("", "file"):
        return lambda path: fs.LocalFileSystem().open_input_stream(path.removeprefix("file://").removeprefix("file:"), buffer_size=0)

    def stream(path: str):
        store, inside = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        return store.open_input_stream(inside, buffer_size=0)

    return stream if scheme in ("hdfs", "s3", "gs", "gcs", "abfs") else None


def _digested(piece: int, stream):
    import hashlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digest, seen = hashlib.sha256(), 0
                with stream(path) as f:
                    while data := f.read(piece):
                        digest.update(data)
                        seen += len(data)
                if seen != size:
                    raise OSError(f"{path} changed: {seen} bytes for {size}")
                out.append((path.rsplit("/", 1)[-1], seen, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["file", "bytes", "sha256"])

    return run


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, bytes, sha256) of every file under ``path``, of any size.

    Spark lists the files and deals them out over tasks; a task reads a file in
    pieces, since a digest has no parts, and holds one piece. Stores that only
    Spark can read give a file as one value, which Spark refuses over 2 GB. A
    file that changes while it is read is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    scheme = path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file").split(":", 1)[0]
    stream = _opener(scheme)
    if stream is None:
        return digests(files.withColumn("name", F.element_at(F.split("path", "/"), -1)), "name", "content")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    listed = files.select(plain("path").alias("path"), "length")
    # Spark's scans pass over empty files; its listing has them
    every = spark.createDataFrame([(unquote(x),) for x in files.inputFiles()], "path string").select(plain("path").alias("path"))
    empty = every.join(listed, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"))
    dealt = listed.union(empty).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(_digested(PIECE, stream), "file string, bytes long, sha256 string")


def full_manifest(spark: SparkSession, path: str, tag: str, commands: list[str] | None = None) -> str:
    """The manifest of a release as Markdown: files with digests, versions, and the commands that made them."""
    import platform
    import sys

    versions = {"python": sys.version.split()[0], "spark": spark.version, "system": platform.system(), "machine": platform.machine()}
    out = [f"# Release {tag}", "", markdown(manifest(spark, path).orderBy("file", "sha256"), "Files"), "## Environment", "", *[f"- {k}: {v}" for k, v in versions.items()], "", "## Commands", ""]
    return "\n".join([*out, *[f"    {c}" for c in commands or ["(none given)"]], ""])


def final_report(title: str, sections: dict[str, DataFrame | None], notes: list[str] | None = None) -> str:
    """Tables under headings, in order; a section without a table or rows says so."""
    parts = [f"# {title}", ""]
    for name, df in sections.items():
        parts.append(f"## {name}\n\n_(no data)_\n" if df is None else markdown(df, name))
    return "\n".join([*parts, *[f"- {n}" for n in notes or ()], ""])


def config_audit(entries: DataFrame, required_keys: DataFrame, required_names: DataFrame) -> DataFrame:
    """What a configuration lacks: ``entries(name, key)`` against keys that every name needs and names that must be there."""
    names = entries.select("name").distinct()
    wanted = sorted(r["key"] for r in required_keys.select("key").dropna().distinct().collect())  # a configuration's keys are few
    keys = names.withColumn("key", F.explode(F.array(*[F.lit(k) for k in wanted]))).join(entries, ["name", "key"], "left_anti")
    gone = required_names.select("name").distinct().join(names, "name", "left_anti")
    return keys.select("name", "key", F.lit("missing key").alias("problem")).union(gone.select("name", F.lit(None).cast("string"), F.lit("missing entry")))


def markdown(df: DataFrame, title: str, limit: int | None = None) -> str:
    """A report frame as a Markdown table; a report is small. With ``limit`` the number of rows left out is stated."""
    rows = df.collect() if limit is None else df.limit(limit).collect()
    if not rows:
        return f"## {title}\n\n_(no data)_\n"
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    body = ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]
    more = 0 if limit is None or len(rows) < limit else df.count() - len(rows)
    tail = [f"_({more} more rows)_", ""] if more else []
    return "\n".join([f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *body, "", *tail])


def acceptance(scores: DataFrame) -> DataFrame:
    """Gate: two of three measures improve, coverage within five points, skill at least that of the ensemble."""
    votes = sum((F.col(f"{m}_model") < F.col(f"{m}_base")).cast("int") for m in ("crps", "brier", "loss"))
    return scores.withColumn("votes", votes).withColumn("accepted", (votes >= 2) & (F.col("coverage_error") <= 0.05) & (F.col("skill") >= 0))


def subgroup_errors(points: DataFrame, subgroup: str) -> DataFrame:
    return points.groupBy(subgroup).agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("q50")).alias("bias"), F.avg(F.abs(F.col("y") - F.col("q50"))).alias("mae"))
