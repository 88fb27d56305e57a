"""Reading and writing of series, forecasts, diagnostics and configuration."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

# The accepted names of the canonical columns of quantile tables, in order of preference.
ALIASES = {
    "indicator": ["indicator", "variable", "series"],
    "horizon": ["horizon", "h", "step", "lead"],
    "q05": ["q05", "q5", "p5", "p05", "q0.05", "quantile_5", "quantile_05"],
    "q25": ["q25", "p25", "quantile_25"],
    "q50": ["q50", "q0.5", "median", "p50", "quantile_50"],
    "q75": ["q75", "p75", "quantile_75"],
    "q95": ["q95", "p95", "q0.95", "quantile_95"],
    "lo_50": ["lo_50", "l50", "lo50", "lower50", "lower_50", "band50_lo", "low50", "lo-50"],
    "hi_50": ["hi_50", "u50", "hi50", "upper50", "upper_50", "band50_hi", "high50", "hi-50"],
    "lo_90": ["lo_90", "l90", "lo90", "lower90", "lower_90", "band90_lo", "low90", "lo-90"],
    "hi_90": ["hi_90", "u90", "hi90", "upper90", "upper_90", "band90_hi", "high90", "hi-90"],
}
BOM = "\ufeff"


def read_csv(spark: SparkSession, path, **options) -> DataFrame:
    """Headed CSV as strings, in UTF-8 or else Latin-1.

    Bytes are read one to one and every cell is decoded by what it holds, so
    no scan goes before the first use.
    """
    df = spark.read.options(**{"header": True, "inferSchema": False, "encoding": "ISO-8859-1", **options}).csv(path)

    def name(c: str) -> str:
        try:
            return c.encode("latin-1").decode("utf-8").lstrip(BOM)
        except UnicodeError:
            return c

    def cell(c: str):
        data = F.encode(F.col(f"`{c}`"), "ISO-8859-1").cast("string")
        return F.when(F.is_valid_utf8(data), data).otherwise(F.col(f"`{c}`")).alias(name(c))

    return df.select(*[cell(c) for c in df.columns])


def read_indexed(spark: SparkSession, path, key: str = "key", **options) -> DataFrame:
    """Headed CSV whose first column, whatever its name, becomes ``key``."""
    df = read_csv(spark, path, **options)
    return df.withColumnRenamed(df.columns[0], key)


def safe_read_csv(spark: SparkSession, path) -> DataFrame | None:
    """The table, or None where it, or its first row, can't be read."""
    try:
        df = read_csv(spark, path)
        df.head(1)
        return df
    except Exception:
        return None


def probe_csv(spark: SparkSession, path, separators=(",", ";", "\t", "|"), rows: int = 2000) -> tuple[str, str] | None:
    """(separator, encoding) of a table, by its first ``rows`` lines; None where no separator gives columns.

    UTF-8 if the lines are, else Latin-1; the first separator under which the
    header has two cells or more and nine lines in ten have as many as it.
    """
    import csv

    whole = spark.read.options(encoding="ISO-8859-1", sep="\x01", quote="", escape="", header=False).csv(path)
    data = "\n".join([r[0] or "" for r in whole.limit(rows).collect()]).encode("latin-1")
    try:
        encoding, text = "UTF-8", data.decode("utf-8").lstrip(BOM)
    except UnicodeError:
        encoding, text = "ISO-8859-1", data.decode("latin-1")
    for sep in separators:
        widths = [len(r) for r in csv.reader(text.splitlines(), delimiter=sep) if r]
        if widths and widths[0] > 1 and sum(w == widths[0] for w in widths) >= 0.9 * len(widths):
            return sep, encoding
    return None


def shared_folder(spark: SparkSession) -> str:
    """Where a query may write tables that all machines read: the checkpoint folder; a session of one machine may do with the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not path and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return (path or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def newest(paths: list[str]) -> str | None:
    """The last path by name."""
    return max(paths, default=None)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that match a glob, in whatever store Spark reads, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or ())


def list_file(spark: SparkSession, path: str) -> list[str]:
    """Paths in a text file, one on a line, blank lines dropped."""
    return [r.value.strip() for r in spark.read.text(path).where(F.trim("value") != "").collect()]


def normalize_quantiles(df: DataFrame) -> DataFrame:
    """Canonical names for the columns of a quantile table, whatever aliases it uses; numbers are parsed, bad ones null."""
    at = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {name: next(at[a] for a in names if a in at) for name, names in ALIASES.items() if any(a in at for a in names)}
    missing = {"indicator", "horizon", "q50"} - found.keys()
    if missing:
        raise ValueError(f"no column for {', '.join(sorted(missing))}")
    kind = lambda n: "string" if n == "indicator" else "long" if n == "horizon" else "double"
    cols = []
    for name, c in found.items():
        x = F.trim(F.col(f"`{c}`").cast("string"))
        x = F.regexp_extract(x, r"^[hH]?(\d+)", 1) if name == "horizon" else x
        cols.append((x if name == "indicator" else x.try_cast(kind(name))).alias(name))
    return df.select(*cols)


def resolve(columns: list[str], candidates: list[str]) -> str | None:
    """First of the candidates that the table has."""
    return next((c for c in candidates if c in columns), None)


def columns_with(columns: list[str], *parts: str) -> list[str]:
    return [c for c in columns if all(p.lower() in c.lower() for p in parts)]


def headed_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, head, cells) of every line but the first of all headed CSV files, each by its own header, in lower case.

    Lines are read by splits, so files may be of any size. Cells may be quoted,
    but hold no line breaks. A line equal to the header is no data.
    """
    clean = F.regexp_replace("value", "^\ufeff|\r$", "")
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"), clean.alias("line"))
    lines = lines.where(F.trim("line") != "")
    first = lines.where("start = 0").groupBy("path").agg(F.min(F.struct("i", "line")).alias("f")).select("path", F.col("f.line").alias("first"))
    # a cell is quoted, with doubled quotes inside, or runs to the next comma
    unquoted = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, 2, F.greatest(F.length(x) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(x)
    cells = lambda line: F.transform(F.regexp_extract_all(line, F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1)), lambda x: F.trim(unquoted(F.trim(x))))
    rows = lines.join(first, "path").where("line <> first")
    return rows.select("path", F.transform(cells(F.col("first")), F.lower).alias("head"), cells(F.col("line")).alias("cells"))


def _named(name):
    """The cell under a header, which is a text or a column; null where the file has no such header."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(F.array_contains("head", name), F.get("cells", F.array_position("head", name).cast("int") - 1))


def read_series_dir(spark: SparkSession, pattern: str) -> DataFrame:
    """All series files of a directory as (indicator, t, value); the file's name is the indicator.

    The time is the column ``year``, else ``date``; the value is ``value``, else
    the column named as the file. A file without such a value column gives the
    first other number of a line; one without either time column is read by
    place: time first, value second.
    """
    from tidecast.operators.series import year_from_text

    rows = headed_lines(spark, pattern).withColumn("indicator", F.regexp_extract("path", r"([^/]+)\.csv$", 1))
    own = F.lower("indicator")
    has = lambda name: F.array_contains("head", name)
    timed = has("year") | has("date")
    by_year = _named("year").try_cast("double").try_cast("int")
    year = F.when(has("year"), by_year).when(has("date"), year_from_text(_named("date"))).otherwise(year_from_text(F.get("cells", F.lit(0))))
    others = F.filter(F.arrays_zip("head", "cells"), lambda c: ~c["head"].isin("year", "date") & c["cells"].try_cast("double").isNotNull())
    value = F.when(has("value"), _named("value")).when(has(own), _named(own)).when(timed, F.get(others, F.lit(0))["cells"]).otherwise(F.get("cells", F.lit(1)))
    return rows.select("indicator", year.cast("long").alias("t"), value.try_cast("double").alias("value")).where("t IS NOT NULL")


def read_series(spark: SparkSession, processed: str, raw: str) -> DataFrame:
    """Processed series, and raw ones of the indicators that have no processed value; nothing is written back."""
    done = read_series_dir(spark, processed).where("value IS NOT NULL") if matching(spark, processed) else spark.createDataFrame([], "indicator string, t long, value double")
    if not matching(spark, raw):
        return done
    return done.union(read_series_dir(spark, raw).join(done.select("indicator").distinct(), "indicator", "left_anti"))


def read_tagged(spark: SparkSession, pattern: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """A tree of run directories, with the run's name and the origin that its name ends in (empty without one).

    Columns are found by their headers, in any order; a file without one of the
    ``required`` columns (all, if not given) is passed over, and so is an empty
    one. Cells that don't fit their type are null.
    """
    fields = StructType.fromDDL(schema).fields
    rows = headed_lines(spark, pattern)
    for name in required if required is not None else [f.name for f in fields]:
        rows = rows.where(F.array_contains("head", name.lower()))
    rows = rows.withColumn("run", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    cols = [_named(f.name.lower()).try_cast(f.dataType).alias(f.name) for f in fields]
    return rows.select(*cols, "run", origin_of(F.col("run")).alias("origin"))


def origin_of(run):
    """The origin that a run's name ends in, before its suffixes; empty without one."""
    return F.regexp_extract(run, r"_(\d{4})(?:_.*)?$", 1)


def flatten_quantiles(nested: DataFrame) -> DataFrame:
    """``(indicator, q map<horizon, map<quantile, value>>)`` as rows; horizons as 5, '5' or 'h5'.

    A map straight from horizon to value holds medians.
    """
    from tidecast.functions import horizon_key

    rows = nested.select("indicator", F.explode("q").alias("h", "m")).select("indicator", horizon_key(F.col("h")).cast("long").alias("horizon"), "m")
    if not isinstance(rows.schema["m"].dataType, MapType):
        quantiles = [F.lit(None).cast("double").alias("q05"), F.col("m").cast("double").alias("q50"), F.lit(None).cast("double").alias("q95")]
    else:
        quantiles = [F.coalesce(*[F.col("m")[a] for a in ALIASES[c]]).cast("double").alias(c) for c in ("q05", "q50", "q95")]
    return rows.select("indicator", "horizon", *quantiles).where("horizon IS NOT NULL")


def write_quantiles(nested: DataFrame, path: str) -> None:
    """Nested quantiles as one CSV file, by indicator and horizon."""
    write_csv(flatten_quantiles(nested), path)


def read_config(text: str, key: str) -> list[dict]:
    """Entries of a JSON or YAML document: a list of mappings, or mappings by name, at the top or under ``key``."""
    try:
        doc = json.loads(text)
    except ValueError:
        doc = parse_yaml(text)
    if isinstance(doc, dict):
        doc = doc.get(key, doc)
    if isinstance(doc, dict):
        doc = [{"name": k, **(v if isinstance(v, dict) else {"value": v})} for k, v in doc.items()]
    return [x for x in doc or () if isinstance(x, dict)]


def config_blocks(text: str) -> list[dict]:
    """Entries of a configuration by patterns alone: a block starts at each ``name:``, its keys are what stands before colons."""
    out: list[dict] = []
    for line in text.splitlines():
        m = re.match(r"\s*(?:-\s*)?([A-Za-z_]\w*)\s*:\s*(.*?)\s*(?:\s#.*)?$", line)
        if m and m[1] == "name":
            out.append({"name": m[2].strip("'\"")})
        elif m and out and line[:1].isspace():
            out[-1][m[1]] = m[2].strip("'\"")
    return out


def parse_yaml(text: str):
    """The block style that configurations use: nested mappings and lists, flow lists and mappings of scalars, quotes, comments."""
    lines = []
    for raw in text.splitlines():
        line = _uncommented(raw).rstrip()
        if line.strip() and line.strip() not in ("---", "..."):
            lines.append((len(line) - len(line.lstrip()), line.strip()))
    doc, at = _yaml_block(lines, 0, lines[0][0]) if lines else (None, 0)
    if at < len(lines):
        raise ValueError(f"line not understood: {lines[at][1]}")
    return doc


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and (not i or line[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (not i or line[i - 1].isspace()):
            return line[:i]
    return line


def _yaml_scalar(x: str):
    x = x.strip()
    if x[:1] in "'\"" and x[:1] and x[-1:] == x[0]:
        return x[1:-1]
    if x[:1] == "[" and x[-1:] == "]":
        return [_yaml_scalar(v) for v in _flow(x[1:-1])]
    if x[:1] == "{" and x[-1:] == "}":
        return {k.strip().strip("'\""): _yaml_scalar(v) for k, v in (p.split(":", 1) for p in _flow(x[1:-1]))}
    if x in ("", "~", "null"):
        return None
    if x in ("true", "false"):
        return x == "true"
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x


def _flow(x: str) -> list[str]:
    """The parts of a flow list between its own commas."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(x):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(x[at:i])
            at = i + 1
    return [p for p in [*out, x[at:]] if p.strip()]


_YAML_KEY = re.compile(r"""("[^"]*"|'[^']*'|[^\s\[\]{},"':#][^:]*?)\s*:(?:\s+(.*))?$""")


def _yaml_block(lines: list[tuple[int, str]], at: int, depth: int):
    out = None
    while at < len(lines) and lines[at][0] == depth:
        body = lines[at][1]
        if body == "-" or body.startswith("- "):
            out = [] if out is None else out
            inner = body[1:].strip()
            inside = depth + len(body) - len(body[1:].lstrip())
            if not inner:
                at += 1
                value, at = _yaml_block(lines, at, lines[at][0]) if at < len(lines) and lines[at][0] > depth else (None, at)
            elif _YAML_KEY.match(inner):
                lines[at] = (inside, inner)
                value, at = _yaml_block(lines, at, inside)
            else:
                value, at = _yaml_scalar(inner), at + 1
            out.append(value)
            continue
        m = _YAML_KEY.match(body)
        if not m or isinstance(out, list):
            break
        out = {} if out is None else out
        at += 1
        if m[2]:
            value = _yaml_scalar(m[2])
        elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("-")):
            value, at = _yaml_block(lines, at, lines[at][0])
        else:
            value = None
        out[m[1].strip("'\"")] = value
    return out, at


#: Columns by which the rows of report files are sorted, those that a table has.
SORT_KEYS = ["run", "model", "origin", "indicator", "indicator_a", "indicator_b", "region", "level", "horizon", "t", "name", "key", "file"]


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One headed CSV file of a small report frame, sorted by ``order`` or the usual keys, nulls last; an empty one is refused."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    keys = [F.col(c).asc_nulls_last() for c in (order if order is not None else [c for c in SORT_KEYS if c in df.columns])]
    one = df.coalesce(1)
    (one.sortWithinPartitions(*keys) if keys else one).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_notes(spark: SparkSession, path: str, lines: list[str]) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
