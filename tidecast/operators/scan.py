"""Recursions over long series as an associative scan.

A series is cut into chunks of ``CHUNK`` steps by its time. Each chunk is
folded into one element, the recursion's effect on any state that it may start
from, and the elements of a series are composed in the order of time. So the
chunks of one series are worked on by many tasks, and a row holds a chunk or the
elements of a series, one for ``CHUNK`` steps, never the series.

The filter of a level under noise has elements of seven numbers: from a start
``x`` the state after the chunk is normal with mean ``a * x + b`` and variance
``c``, and the chunk's likelihood is ``exp(-(s - 2 * e * x + j * x**2 + l) / 2)``.
Numbers are relative to the chunk's own origin ``o``, so that large levels cost
no digits. A diffuse start closes the composition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions import num
from tidecast.operators.series import KEY

#: Steps of a chunk at most; a series of 16 million steps is a row of 4,096 elements.
CHUNK = 4096


def chunks(obs: DataFrame, *keys: str, size: int | None = None) -> DataFrame:
    """(keys, chunk, y): the values of ``size`` steps in the order of time. Steps without value count for nothing."""
    rows = obs.where("value IS NOT NULL")
    cell = F.floor(F.col("t") / F.lit(size or CHUNK)).alias("chunk")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda s: s["value"])
    return rows.groupBy(*(keys or (KEY,)), cell).agg(ordered.alias("y"))


def compose(elements: DataFrame, keys: list[str], fields: list[str], start: str, step: str) -> DataFrame:
    """(keys, k): the elements of each key composed in the order of ``chunk``; ``start`` is SQL over the first element ``z``, ``step`` over what is composed, ``f``, and the next, ``g``."""
    rows = F.array_sort(F.collect_list(F.struct("chunk", *fields)))
    got = elements.groupBy(*keys).agg(rows.alias("_e"))
    got = got.withColumn("_z", F.get("_e", F.lit(0))).withColumn("_s", F.expr(start.replace("z.", "_z.")))
    return got.select(*keys, F.expr(f"aggregate(slice(_e, 2, size(_e)), _s, (f, g) -> {step})").alias("k"))


# -- smoothing ----------------------------------------------------------------


def smoothed_level(obs: DataFrame, gain: Column | float, *keys: str) -> DataFrame:
    """(keys, level, n): the last level of simple exponential smoothing, which starts at the first value.

    ``gain`` is a number, or a column of the keys.
    """
    keys = list(keys or (KEY,))
    g = gain if isinstance(gain, Column) else F.lit(float(gain))
    each = chunks(obs, *keys).withColumn("g", g)
    # a chunk multiplies the level before it by (1 - g) ** n and adds what its own values leave
    each = each.withColumn("n", F.size("y")).withColumn("first", F.get("y", F.lit(0)))
    each = each.withColumn("b", F.aggregate("y", F.lit(0.0), lambda a, y: a + F.col("g") * (y - a))).withColumn("a", F.pow(1 - F.col("g"), F.col("n")))
    got = compose(each, keys, ["a", "b", "first", "n"], "named_struct('x', z.a * z.first + z.b, 'n', z.n)", "named_struct('x', g.a * f.x + g.b, 'n', f.n + g.n)")
    return got.select(*keys, F.col("k.x").alias("level"), F.col("k.n").cast("long").alias("n"))


# -- a level under noise --------------------------------------------------------

_FIELDS = ["o", "a", "b", "c", "e", "j", "s", "l"]


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _observe(q: str, r: str, v: str, f: str = "f") -> str:
    """The element ``f`` after one more value ``v`` (relative to its origin), with state variance ``q`` and noise ``r``."""
    d = f"({f}.c + {r})"
    return _struct(
        o=f"{f}.o",
        a=f"{f}.a * {r} / {d}",
        b=f"({f}.b * {r} + {f}.c * ({v})) / {d}",
        c=f"{q} + {f}.c * {r} / {d}",
        e=f"{f}.e + {f}.a * (({v}) - {f}.b) / {d}",
        j=f"{f}.j + {f}.a * {f}.a / {d}",
        s=f"{f}.s + (({v}) - {f}.b) * (({v}) - {f}.b) / {d}",
        l=f"{f}.l + ln({d})",
    )


def _join() -> str:
    """``f`` and then ``g``, whose origin is brought to that of ``f``."""
    shift = "(f.o - g.o)"
    e2 = f"(g.e - g.j * {shift})"
    s2 = f"(g.s - 2e0 * g.e * {shift} + g.j * {shift} * {shift})"
    b2 = f"(g.b + g.a * {shift} - {shift})"
    d = "(1e0 + f.c * g.j)"
    return _struct(
        o="f.o",
        a=f"f.a * g.a / {d}",
        b=f"g.a * (f.b + f.c * {e2}) / {d} + {b2}",
        c=f"g.c + g.a * g.a * f.c / {d}",
        e=f"f.e + f.a * ({e2} - g.j * f.b) / {d}",
        j=f"f.j + f.a * f.a * g.j / {d}",
        s=f"f.s + {s2} + (g.j * f.b * f.b - 2e0 * {e2} * f.b - f.c * {e2} * {e2}) / {d}",
        l=f"f.l + g.l + ln({d})",
    )


def _identity(origin: str) -> str:
    return _struct(o=origin, a="1e0", b="0e0", c="0e0", e="0e0", j="0e0", s="0e0", l="0e0")


def _closed(df: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """(keys, mean, variance, s, l): from a diffuse start, the state before the next value and the parts of the likelihood."""
    k = F.col("k")
    over = lambda x: F.try_divide(x, k["j"])  # noqa: E731  nothing is known where no value was seen
    mean = k["o"] + k["a"] * over(k["e"]) + k["b"]
    return df.select(*keys, mean.alias("mean"), (k["c"] + over(k["a"] * k["a"])).alias("variance"), (k["s"] - over(k["e"] * k["e"])).alias("s"), (k["l"] + F.log(k["j"])).alias("l"), *[k[m].alias(m) for m in more])


def level_elements(each: DataFrame, keys: list[str], q: str = "q", r: str = "1e0") -> DataFrame:
    """(keys, chunk, n, the element's fields): the filter's element of every chunk ``y`` with state variance ``q`` and noise ``r`` (SQL over the row)."""
    start = _identity("get(y, 0)")
    folded = F.expr(f"aggregate(y, {start}, (f, v) -> {_observe(q, r, 'v - f.o')})")
    return each.select(*keys, "chunk", F.size("y").alias("n"), folded.alias("_f")).select(*keys, "chunk", "n", *[F.col("_f")[f].alias(f) for f in _FIELDS])


def level_filter(each: DataFrame, keys: list[str], q: str = "q", r: str = "1e0") -> DataFrame:
    """(keys, mean, variance, s, l, n): the filter over the chunks ``each`` of a series, for every key."""
    start = _struct(**{f: f"z.{f}" for f in ["n", *_FIELDS]})
    step = _join().replace("named_struct(", "named_struct('n', f.n + g.n, ", 1)
    return _closed(compose(level_elements(each, keys, q, r), keys, [*_FIELDS, "n"], start, step), keys, ["n"])


def trend_filter(obs: DataFrame, level_var: float, trend_var: float, *keys: str) -> DataFrame:
    """(keys, last, trend, n): a level seen without noise whose trend is filtered; ``n`` counts the values, of which one has trend 0.

    Differences of the values are the trend under the level's own noise, so
    this is the filter of a level over differences. The difference between two
    chunks is taken where they are composed.
    """
    keys = list(keys or (KEY,))
    q, r = num(trend_var), num(level_var)
    each = chunks(obs, *keys).withColumn("first", F.get("y", F.lit(0))).withColumn("last", F.element_at("y", -1)).withColumn("n", F.size("y"))
    steps = F.expr("transform(sequence(1, greatest(size(y) - 1, 1)), i -> get(y, i) - get(y, i - 1))")
    each = each.withColumn("d", F.when(F.size("y") > 1, steps).otherwise(F.array().cast("array<double>")))
    folded = F.expr(f"aggregate(d, {_identity('0e0')}, (f, v) -> {_observe(q, r, 'v')})")
    each = each.withColumn("_f", folded).select("*", *[F.col("_f")[f].alias(f) for f in _FIELDS])
    fields = ["first", "last", "n", *_FIELDS]
    start = _struct(**{f: f"z.{f}" for f in fields})
    # the difference between the chunks is one more value of ``f``, which makes it ``w``
    joined = _join().replace("f.", "w.").replace("named_struct(", "named_struct('first', f.first, 'last', g.last, 'n', f.n + g.n, ", 1)
    step = f"get(transform(array({_observe(q, r, 'g.first - f.last')}), w -> {joined}), 0)"
    got = _closed(compose(each, keys, fields, start, step), keys, ["last", "n"])
    return got.select(*keys, "last", F.coalesce("mean", F.lit(0.0)).alias("trend"), "n")
