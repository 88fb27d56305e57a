"""The stages as commands: each reads CSV files, builds one plan and writes CSV."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast import sources
from tidecast.functions import boolean_text
from tidecast.operators import calibrate, combine, forecast, govern, score, series as sr, stats

MODELS = {"local-level": forecast.local_level, "drift": forecast.drift_forecast, "shock": forecast.shock_moments, "trend": forecast.local_trend}


def load_series(spark: SparkSession, path: str, indicators: list[str] | None = None) -> DataFrame:
    """Annual means of every series file that matches ``path`` (``dir/*.csv``), for all or the named indicators."""
    rows = sources.read_series_dir(spark, path)
    if indicators:
        rows = rows.where(F.col("indicator").isin(indicators))
    return rows.groupBy("indicator", "t").agg(F.avg("value").alias("value"))


def load_forecast(spark: SparkSession, path: str) -> DataFrame:
    return sources.normalize_quantiles(sources.read_csv(spark, path))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidecast", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: str, **kinds):
        c = sub.add_parser(name)
        c.add_argument("--out", required=True)
        for f in flags:
            kind = kinds.get(f, {})
            c.add_argument(f"--{f}", required="default" not in kind, **kind)
        return c

    many, origins = {"nargs": "+", "default": None}, {"nargs": "+", "type": int}
    h = {"type": int, "default": 15}
    add("forecast", "series", "origin", "model", "h", "indicators", model={"choices": MODELS, "default": "local-level"}, h=h, indicators=many, origin={"type": int})
    kinds = {"model": {"choices": ["walk", "jump"], "default": "walk"}, "t-df": {"type": int, "default": 4}}
    kinds |= {"h-scored": {"type": int, "default": 15}, "out-scored": {"default": None}}
    add("simulate", "series", "origin", "h", "h-scored", "out-scored", "paths", "rate", "model", "t-df", "indicators", **kinds, h={"type": int, "default": 40}, paths={"type": int, "default": 10000}, rate={"type": float, "default": 0.2}, indicators=many, origin={"type": int})
    for name in ("calibrate-sigma", "calibrate-mean"):
        add(name, "forecast", "series", "origins", "target", "indicators", origins=origins, target={"type": float, "default": 0.9}, indicators=many)
    add("sigma-scales", "forecast", "series", "origins", "target", "indicators", origins=origins, target={"type": float, "default": 0.9}, indicators=many)
    add("batch", "series", "origins", "model", "h", "target", "indicators", model={"choices": MODELS, "default": "local-level"}, h=h, target={"type": float, "default": 0.9}, indicators=many, origins=origins)
    for name in ("evaluate-runs", "pivot-runs"):
        add(name, "runs", "pits", "indicators", pits={"default": None}, indicators=many)
    for name in ("alpha", "bias"):
        add(name, "forecast", "series", "origin", "indicators", origin={"type": int}, indicators=many)
    add("rescale", "forecast", "indicator", "alpha", indicator={"default": None}, alpha={"type": float})
    for name in ("verify", "calibration", "crps", "evaluate", "significance"):
        add(name, "forecast", "series", "origin", "indicators", origin={"type": int}, indicators=many)
    add("reliability", "forecast", "series", "origin", "bins", "indicators", origin={"type": int}, bins={"type": int, "default": 10}, indicators=many)
    add("ensemble", "list")
    add("overlap", "forecast")
    add("proxy", "forecast", "proxy", "origin", origin={"type": int})
    add("match-sample", "forecast", "series", "origin", "indicators", origin={"type": int}, indicators=many)
    for name in ("annualise", "breaks", "correlate"):
        add(name, "series", "indicators", indicators=many)
    add("rollup", "runs")
    add("report", "table", "title", title={"default": "Report"})
    add("final-report", "tables", "title", "notes", tables={"nargs": "+"}, title={"default": "Final report"}, notes={"nargs": "*", "default": None})
    add("release-manifest", "path", "tag", "commands", commands={"nargs": "*", "default": None})
    add("validate", "config", "key", "keys", "names", key={"default": "indicators"}, keys={"nargs": "+"}, names={"nargs": "+"})
    add("manifest", "path")
    return p


def plan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The result of a command, not yet run."""
    series = load_series(spark, a.series, getattr(a, "indicators", None)) if hasattr(a, "series") else None
    fcst = load_forecast(spark, a.forecast) if hasattr(a, "forecast") else None
    if a.command == "forecast":
        return MODELS[a.model](series, a.origin, a.h)
    if a.command == "simulate":
        past = forecast.train(series, a.origin, 8)
        params = forecast.standardised_steps(past) if a.model == "jump" else forecast.moments(past)
        params = params.withColumn("no", F.pmod(F.xxhash64("indicator"), F.lit(1 << 20)))
        if a.model == "jump":
            sim = forecast.jump_paths(params, a.paths, a.h, rate=a.rate, df=a.t_df)
        else:
            sim = forecast.paths(params, a.paths, a.h, rate=a.rate)
        return forecast.scored_and_scenario(sim, a.h_scored)
    if a.command == "batch":
        return batch(series, a.origins, MODELS[a.model], a.h, a.target)
    if a.command in ("evaluate-runs", "pivot-runs"):
        covered = sources.read_tagged(spark, a.runs, "indicator string, horizon long, level double, covered string").withColumn("covered", boolean_text(F.col("covered")))
        if a.indicators:
            covered = covered.where(F.col("indicator").isin(a.indicators))
        if a.command == "pivot-runs":
            return score.coverage_pivot(score.coverage_summary(covered))
        pits = sources.read_tagged(spark, a.pits, "indicator string, horizon long, pit double") if a.pits else covered.select("indicator", "horizon", F.lit(None).cast("double").alias("pit"))
        return score.metrics_by_horizon(covered, pits)
    if a.command == "ensemble":
        return combine.ensemble_equal({p: load_forecast(spark, p) for p in sources.list_file(spark, a.list)})
    if a.command == "overlap":
        return combine.overlap_matrix(fcst)
    if a.command == "rescale":
        return calibrate.rescale_bands(fcst, a.alpha, a.indicator)
    if a.command == "proxy":
        rows = sources.read_csv(spark, a.proxy)
        rows = rows.select("region", "indicator", F.col("year").try_cast("long").alias("t"), F.col("value").try_cast("double").alias("value"))
        return combine.proxy_validation(fcst, rows, a.origin)
    if a.command == "match-sample":
        return calibrate.match_sample(fcst, series, a.origin)
    if a.command == "annualise":
        return sr.densify(series)
    if a.command == "breaks":
        return sr.break_flags(series)
    if a.command == "correlate":
        return sr.correlation_pairs(series)
    if a.command == "rollup":
        return sources.read_tagged(spark, a.runs, "indicator string, level double, covered long, total long, coverage_rate double")
    if a.command == "validate":
        return audit(spark, a.config, a.key, a.keys, a.names)
    if a.command == "manifest":
        return govern.manifest(spark, a.path)
    points = calibrate.join_truth(fcst, series, a.origins if hasattr(a, "origins") else a.origin)
    covered = score.coverage_points(points)
    match a.command:
        case "calibrate-sigma":
            return calibrate.scale_spread(fcst, calibrate.sigma_scales(fcst, points, target=a.target))
        case "sigma-scales":
            return calibrate.sigma_scales(fcst, points, target=a.target)
        case "calibrate-mean":
            return calibrate.apply_mean(fcst, calibrate.mean_fit(points))
        case "alpha":
            return calibrate.least_alpha(points)
        case "bias":
            return calibrate.shift(fcst, calibrate.bias(points))
        case "verify":
            return score.coverage_summary(covered)
        case "calibration":
            return score.coverage_rollup(points).join(score.ks_uniform(score.pit(points)).select("indicator", "ks"), "indicator", "left")
        case "reliability":
            return score.reliability(score.pit(points), a.bins)
        case "crps":
            return score.crps(points).select("indicator", "origin", "horizon", "y", "mu", "sigma", "crps")
        case "evaluate":
            return score.metrics_by_horizon(covered, score.pit(points))
    summary = score.coverage_summary(covered)
    return stats.significance(summary.select("indicator", "level", F.col("covered").alias("x"), F.col("total").alias("n")))


def batch(series: DataFrame, origins: list[int], model, h: int, target: float) -> DataFrame:
    """Forecast, spread calibration and verification at every origin: coverage by indicator, origin and level."""
    points = calibrate.join_rolling(forecast.rolling(series, origins, model, h), series)
    scales = calibrate.by_origin(points, lambda p: calibrate.spread_search(p, target)).select("indicator", "origin", "alpha")
    move = lambda c: (F.col("q50") + F.col("alpha") * (F.col(c) - F.col("q50"))).alias(c)
    scaled = points.join(scales, ["indicator", "origin"]).select("indicator", "origin", "horizon", "t", "y", move("q05"), "q50", move("q95"))
    return calibrate.by_origin(scaled, lambda p: score.coverage_summary(score.coverage_points(p)))


def audit(spark: SparkSession, path: str, key: str, keys: list[str], names: list[str]) -> DataFrame:
    """What a JSON or YAML configuration lacks of the wanted keys and entries; a configuration is one small file."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    entries = [(x["name"], k) for x in sources.read_config(row.value, key) if "name" in x for k in x]
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    return govern.config_audit(spark.createDataFrame(entries, "name string, key string"), one(keys, "key"), one(names, "name"))


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tidecast {a.command}").getOrCreate()
    if a.command == "report":
        text = govern.markdown(sources.read_csv(spark, a.table), a.title)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.out)
        return
    if a.command in ("final-report", "release-manifest"):
        tables = {t.rstrip("/").rsplit("/", 1)[-1]: sources.safe_read_csv(spark, t) for t in getattr(a, "tables", ())}
        text = govern.final_report(a.title, tables, a.notes) if a.command == "final-report" else govern.full_manifest(spark, a.path, a.tag, a.commands)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.out)
        return
    out = plan(spark, a)
    if a.command == "simulate":
        if a.out_scored:
            sources.write_csv(out.where("scored").drop("scored"), a.out_scored)
        out = out.drop("scored")
    sources.write_csv(out, a.out)


if __name__ == "__main__":
    main()
