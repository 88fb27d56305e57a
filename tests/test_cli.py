from tidecast import cli, sources


def test_forecast_calibrate_verify(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name, k in (("alpha", 3), ("beta", 5)):
        rows = "\n".join(f"{1970 + t}-01-01,{t * 0.5 + (t * k) % 7}" for t in range(40))
        (tmp_path / "s" / f"{name}.csv").write_text(f"date,value\n{rows}\n")
    series = f"{tmp_path}/s/*.csv"
    run = lambda *args: cli.main([*args, "--out", f"{tmp_path}/{args[0]}"])
    read = lambda name: sources.read_csv(spark, f"{tmp_path}/{name}")
    run("forecast", "--series", series, "--origin", "1995", "--h", "10")
    assert read("forecast").count() == 20
    f = f"{tmp_path}/forecast"
    run("calibrate-sigma", "--forecast", f, "--series", series, "--origins", "1990", "1995")
    assert {"q05", "q50", "q95", "alpha"} <= set(read("calibrate-sigma").columns)
    for command in ("verify", "calibration", "reliability", "crps", "evaluate", "significance", "alpha", "bias"):
        run(command, "--forecast", f, "--series", series, "--origin", "1995", "--indicators", "alpha")
        assert {r.indicator for r in read(command).select("indicator").collect()} - {"ALL"} <= {"alpha", "beta"}
    run("calibrate-mean", "--forecast", f, "--series", series, "--origins", "1995")
    run("simulate", "--series", series, "--origin", "1995", "--h", "4", "--paths", "50")
    assert read("simulate").count() == 8
    (tmp_path / "list.txt").write_text(f"{f}\n{tmp_path}/calibrate-mean\n")
    run("ensemble", "--list", f"{tmp_path}/list.txt")
    run("overlap", "--forecast", f)
    run("rescale", "--forecast", f, "--alpha", "0.85")
    (tmp_path / "proxy.csv").write_text("year,value,indicator,region\n1996,14,alpha,X\n2020,1,alpha,X\n")
    run("proxy", "--forecast", f, "--proxy", f"{tmp_path}/proxy.csv", "--origin", "1995")
    assert read("proxy").count() == 2
    run("manifest", "--path", f"{tmp_path}/s")
    assert read("manifest").count() == 2
    run("simulate", "--series", series, "--origin", "1995", "--h", "4", "--paths", "50", "--model", "jump", "--t-df", "3")
    assert read("simulate").count() == 8
    run("simulate", "--series", series, "--origin", "1995", "--h", "6", "--h-scored", "2", "--out-scored", f"{tmp_path}/scored", "--paths", "50")
    assert read("simulate").count() == 12 and read("scored").count() == 4
    run("sigma-scales", "--forecast", f, "--series", series, "--origins", "1995", "--indicators", "alpha")
    assert {(r.indicator, r.alpha) for r in read("sigma-scales").where("coverage_before is null").collect()} == {("beta", "1.0")}
    run("batch", "--series", series, "--origins", "1985", "1995", "--h", "5")
    assert read("batch").count() == 8 and {r.origin for r in read("batch").collect()} == {"1985", "1995"}
    run("final-report", "--tables", f"{tmp_path}/batch", f"{tmp_path}/nowhere", "--notes", "one")
    assert "## batch" in [r.value for r in spark.read.text(f"{tmp_path}/final-report").collect()]
    run("release-manifest", "--path", f"{tmp_path}/s", "--tag", "v1", "--commands", "make it")
    (tmp_path / "diag" / "m_1995_cal").mkdir(parents=True)
    (tmp_path / "diag" / "m_1995_cal" / "points.csv").write_text("level,covered,indicator,horizon\n0.5,yes,alpha,1\n0.9,0,alpha,1\n")
    run("evaluate-runs", "--runs", f"{tmp_path}/diag/*/*.csv")
    (row,) = read("evaluate-runs").collect()
    assert (row.covered_50_rate, row.covered_90_rate) == ("1.0", "0.0")
    run("pivot-runs", "--runs", f"{tmp_path}/diag/*/*.csv")
    run("match-sample", "--forecast", f, "--series", series, "--origin", "1995")
    assert read("match-sample").count() == 20
    run("annualise", "--series", series)
    assert read("annualise").count() == 80
    run("correlate", "--series", series)
    assert read("correlate").count() == 1
    run("breaks", "--series", series)
    run("report", "--table", f"{tmp_path}/correlate", "--title", "Pairs")
    assert "## Pairs" in [r.value for r in spark.read.text(f"{tmp_path}/report").collect()]
    (tmp_path / "runs" / "walk_1995_cal").mkdir(parents=True)
    (tmp_path / "runs" / "walk_1995_cal" / "s.csv").write_text("indicator,level,covered,total,coverage_rate\nalpha,0.9,3,4,0.75\n")
    run("rollup", "--runs", f"{tmp_path}/runs/*/*.csv")
    (row,) = read("rollup").collect()
    assert (row.run, row.origin, row.covered) == ("walk_1995_cal", "1995", "3")
    (tmp_path / "c.yml").write_text("indicators:\n  - name: alpha\n    unit: pct\n")
    run("validate", "--config", f"{tmp_path}/c.yml", "--keys", "unit", "transform", "--names", "alpha", "beta")
    assert {(r.name, r.key) for r in read("validate").collect()} == {("alpha", "transform"), ("beta", None)}
