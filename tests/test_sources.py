import pytest
from pyspark.sql import functions as F

from tidecast import sources
from tidecast.streaming import windowed_mean


def test_encoding_fallback_and_bom(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,x\ncafé,1\n".encode())
    (tmp_path / "b.csv").write_bytes("name,x\ncafé,1\n".encode("latin-1"))
    for f in "ab":
        df = sources.read_csv(spark, f"{tmp_path}/{f}.csv")
        assert df.columns == ["name", "x"] and df.first().name == "café"
    assert sources.safe_read_csv(spark, f"{tmp_path}/none.csv") is None
    (tmp_path / "c.csv").write_text("a;b\n1;2\n")
    assert sources.probe_csv(spark, f"{tmp_path}/c.csv") == (";", "UTF-8")


def test_quantile_aliases(spark):
    df = spark.createDataFrame([("a", "h3", "1", "2", "bad")], "Series string, H string, p5 string, Median string, P95 string")
    (r,) = sources.normalize_quantiles(df).collect()
    assert tuple(r) == ("a", 3, 1.0, 2.0, None)
    with pytest.raises(ValueError):
        sources.normalize_quantiles(spark.createDataFrame([(1,)], "x int"))


def test_series_directory(spark, tmp_path):
    (tmp_path / "one.csv").write_text("value,date\n1.5,1972-01-01\n,1973-01-01\n")
    (tmp_path / "two.csv").write_text("Year,value\n1980,x\n1981,4\n")
    (tmp_path / "zero.csv").write_text("date,value\n")
    got = sorted(map(tuple, sources.read_series_dir(spark, f"{tmp_path}/*.csv").collect()))
    assert got == [("one", 1972, 1.5), ("one", 1973, None), ("two", 1980, None), ("two", 1981, 4.0)]


def test_tagged_tree_and_lists(spark, tmp_path):
    for run in ("walk_1995_cal", "plain"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "pit.csv").write_text("indicator,pit\na,0.5\n")
    got = {r.run: r.origin for r in sources.read_tagged(spark, f"{tmp_path}/*/pit.csv", "indicator string, pit double").collect()}
    assert got == {"walk_1995_cal": "1995", "plain": ""}
    (tmp_path / "list.txt").write_text("x.csv\n\n y.csv \n")
    assert sources.list_file(spark, f"{tmp_path}/list.txt") == ["x.csv", "y.csv"] and sources.newest(["b1", "b2"]) == "b2"


def test_nested_quantiles(spark):
    df = spark.createDataFrame([("a", {"h5": {"q5": 1.0, "q50": 2.0, "q95": 3.0}, "6": {"q05": 0.0, "q50": 1.0}})], "indicator string, q map<string, map<string, double>>")
    got = sorted(map(tuple, sources.flatten_quantiles(df).collect()))
    assert got == [("a", 5, 1.0, 2.0, 3.0), ("a", 6, 0.0, 1.0, None)]


def test_configs():
    listed = "indicators:\n  - name: turnout\n    unit: pct\n  - name: trust # note\n"
    assert sources.read_config(listed, "indicators") == [{"name": "turnout", "unit": "pct"}, {"name": "trust"}]
    assert sources.read_config('[{"name": "a"}]', "indicators") == [{"name": "a"}]
    assert sources.read_config('{"baselines": {"ets": {"gain": 1}}}', "baselines") == [{"name": "ets", "gain": 1}]
    assert sources.columns_with(["VCF0201 Dem", "x"], "vcf", "dem") == ["VCF0201 Dem"] and sources.resolve(["b"], ["a", "b"]) == "b"


def test_configs_of_every_shape():
    nested = "# minimal\npersistence:\n  type: naive_last\n  note: \"y # all h\"\nets:\n  type: level\n  params:\n    seasonal: none\n    damped: false\nmix:\n  inputs:\n    - persistence\n    - ets\n  grid: [0.05, 'a, b', {k: 1}]\n"
    got = {x["name"]: x for x in sources.read_config(nested, "baselines")}
    assert list(got) == ["persistence", "ets", "mix"]
    assert got["persistence"]["note"] == "y # all h" and got["ets"]["params"] == {"seasonal": "none", "damped": False}
    assert got["mix"]["inputs"] == ["persistence", "ets"] and got["mix"]["grid"] == [0.05, "a, b", {"k": 1}]
    under = "baselines:\n  ets:\n    gain: 1\n  walk:\n    gain: 2.5\n"
    assert sources.read_config(under, "baselines") == [{"name": "ets", "gain": 1}, {"name": "walk", "gain": 2.5}]
    events = "version: 0.1\nevents:\n  - id: low\n    horizons: [1, 3]\n    why: \"Share 'x' < 20%\"\n  - id: high\n"
    assert sources.read_config(events, "events") == [{"id": "low", "horizons": [1, 3], "why": "Share 'x' < 20%"}, {"id": "high"}]
    assert sources.parse_yaml("") is None and sources.parse_yaml("a: b:c\nempty: {}\n") == {"a": "b:c", "empty": {}}
    blocks = sources.config_blocks("indicators:\n  - name: trust\n    unit: pct # note\n  - name: gini\n")
    assert blocks == [{"name": "trust", "unit": "pct"}, {"name": "gini"}]


def test_probe_reads_its_sample(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name;x\ncafé, crème;1\nthé;2\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("\ufeffname|x\ncafé;b|1\n".encode())
    (tmp_path / "one.csv").write_text("only\n1\n2\n")
    assert sources.probe_csv(spark, f"{tmp_path}/l.csv") == (";", "ISO-8859-1")
    assert sources.probe_csv(spark, f"{tmp_path}/u.csv") == ("|", "UTF-8")
    assert sources.probe_csv(spark, f"{tmp_path}/one.csv") is None
    assert sources.read_csv(spark, f"{tmp_path}/l.csv", sep=";").first()["name"] == "café, crème"
    assert sources.read_indexed(spark, f"{tmp_path}/u.csv", sep="|").columns == ["key", "x"]


def test_tagged_tree_by_name(spark, tmp_path):
    files = {"a_1995_cal": "level,indicator,covered\n0.9,alpha,1\n", "b_2000": "indicator,covered,level,more\nbeta,x,0.5,z\n", "c": "indicator,level\ngamma,0.5\n", "d": "", "e_1990": "indicator,level,covered\n"}
    for run, text in files.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "s.csv").write_text(text)
    got = sorted(map(tuple, sources.read_tagged(spark, f"{tmp_path}/*/s.csv", "indicator string, level double, covered long").collect()))
    assert got == [("alpha", 0.9, 1, "a_1995_cal", "1995"), ("beta", 0.5, None, "b_2000", "2000")]
    assert sources.newest(sources.matching(spark, f"{tmp_path}/*")).endswith("/e_1990")


def test_series_of_every_shape_and_fallback(spark, tmp_path):
    for d in ("raw", "done"):
        (tmp_path / d).mkdir()
    (tmp_path / "raw" / "b.csv").write_text("Entity,Code,Year,Percent\nX,US,1990,4.5\nX,US,1991,\n")
    (tmp_path / "raw" / "c.csv").write_text("when,what\n1990-05-01,7\nbad,8\n")
    (tmp_path / "raw" / "d.csv").write_text("year,value\n1990,1\n")
    (tmp_path / "done" / "d.csv").write_text("value,date\n2,1990-01-01\n")
    got = sorted(map(tuple, sources.read_series(spark, f"{tmp_path}/done/*.csv", f"{tmp_path}/raw/*.csv").collect()))
    assert got == [("b", 1990, 4.5), ("b", 1991, None), ("c", 1990, 7.0), ("d", 1990, 2.0)]
    assert sources.read_series(spark, f"{tmp_path}/none/*.csv", f"{tmp_path}/done/*.csv").count() == 1


def test_scalar_quantiles_and_sorted_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", {"2": 5.0, "h1": 4.0}), ("a", {"1": 3.0})], "indicator string, q map<string, double>")
    sources.write_quantiles(df, f"{tmp_path}/q")
    assert [(r.indicator, r.horizon, r.q50) for r in sources.read_csv(spark, f"{tmp_path}/q").collect()] == [("a", "1", "3.0"), ("b", "1", "4.0"), ("b", "2", "5.0")]
    sources.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_sinks(spark, tmp_path):
    sources.write_csv(spark.createDataFrame([(1, "a")], "x int, s string"), f"{tmp_path}/out")
    assert sources.read_csv(spark, f"{tmp_path}/out").first().s == "a"
    with pytest.raises(ValueError):
        sources.write_csv(spark.createDataFrame([], "x int"), f"{tmp_path}/none")
    sources.append_notes(spark, f"{tmp_path}/notes", ["one"])
    sources.append_notes(spark, f"{tmp_path}/notes", ["two"])
    assert spark.read.text(f"{tmp_path}/notes").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(sf)
    events.write.parquet(f"{tmp_path}/in")
    stream = windowed_mean(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "ts", "event_type", "value")
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        tidy = lambda df: sorted(tuple(r) for r in df.select("indicator", "start", F.round("value", 9), "n").collect())
        assert tidy(spark.table("daily")) == tidy(windowed_mean(events, "ts", "event_type", "value"))
    finally:
        q.stop()


def test_series_named_as_the_file_and_quoted_cells(spark, tmp_path):
    (tmp_path / "trust.csv").write_text('Entity,Code,Year,Trust\n"United, States",USA,1990,"41.5"\n"say ""so""",X,1991,\n')
    got = sorted(map(tuple, sources.read_series_dir(spark, f"{tmp_path}/*.csv").collect()))
    assert got == [("trust", 1990, 41.5), ("trust", 1991, None)]
