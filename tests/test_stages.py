"""From raw files of both markets to composites, by the command line's stages."""

import random

import pytest
from pyspark.sql import functions as F

from tickweave import cli
from tickweave.config import Params
from tickweave.operators.factors import FACTORS
from tickweave.plans.stages import Run
from tickweave.sources.readers import available_days, parse_raw, read_metadata, read_overrides, read_raw, read_table
from tickweave.sources.sinks import export_csv
from tickweave.streaming.days import bars, on_new_rows

BOOK = [f"{s}{w}{i}" for s in ("Ask", "Bid") for w in ("Price", "Volume") for i in range(1, 6)]
IDS = ["000001", "000002", "300003", "600004", "600005", "600006"]


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    rnd, root = random.Random(5), tmp_path_factory.mktemp("raw")
    for day in ("20240102", "20240103"):
        (root / day).mkdir()
        for sec in IDS:
            sz = sec[0] in "03"
            head = ["Date", "UpdateTime", "SecurityID", "PreCloPrice", "LastPrice", "Turnover", "Volume" if sz else "TradVolume", "TradingPhaseCode" if sz else "InstruStatus", *BOOK]
            price, volume, lines = 10.0, 0, [",".join(head)]
            for minute in range(0, 50):
                price *= 1 + rnd.gauss(0, 0.01)
                volume += rnd.randint(1, 50)
                book = [f"{price + (0.01 * i if s == 'Ask' else -0.01 * i):.3f}" if w == "Price" else rnd.randint(1, 99) for s in ("Ask", "Bid") for w in ("Price", "Volume") for i in range(1, 6)]
                status = "H0" if sec == "300003" else "T0" if sz else "TRADE"
                lines.append(",".join(map(str, [day, f"{9 + (minute + 30) // 60}:{(minute + 30) % 60:02d}:01.5", int(sec), 10, f"{price:.3f}", 1, volume, status, *book])))
            lines.append(lines[-1].replace(":01.5", ":99"))
            (root / day / f"{sec}.csv").write_text("\n".join(lines) + "\n")
        (root / day / "_summary.csv").write_text("a,b\n1,2\n")
    (root / "drop.csv").write_text("# comment\nDate,SecurityID,Reason\n\n20240103,2,bad\nALL,600006,gone\n")
    return root


PARAMS = Params(freq="1 minute", sessions=(("09:30:00", "10:00:00"), ("10:00:00", "10:20:00")), horizons=(1, 2), am_end="09:59:59", pm_start="10:00:00", deciles=3, quantiles=2)


def test_readers(spark, raw):
    df = read_raw(spark, str(raw)).cache()
    assert df.count() == 2 * 6 * 51 and {r.security_id for r in df.select("security_id").distinct().collect()} == set(IDS)
    kinds = {(r.security_id, r.market, r.status) for r in df.select("security_id", "market", "status").distinct().collect()}
    assert ("000001", "SZ", "T0") in kinds and ("600004", "SH", "TRADE") in kinds
    assert df.filter("volume is null or AskPrice5 is null").count() == 0
    assert read_raw(spark, str(raw), ["20240103"]).select("day").distinct().count() == 1
    assert [(r.day, r.security, r.reason) for r in read_overrides(spark, str(raw / "drop.csv")).collect()] == [("20240103", "2", "bad"), ("ALL", "600006", "gone")]


def test_raw_dialects_quotes_and_blanks(spark):
    sh = "\ufeffUpdateTime,LastPrice,InstruStatus\n9:30:00,1.5,TRADE\n\n9:30:03,x,TRADE,extra\n9:30:06"
    sz = '"TradingPhaseCode","Volume","UpdateTime"\r\n"T""0","1,5"," 9:31:00 "\r\nT0,7,9:32:00\r\n'
    files = spark.createDataFrame([("x/20240102/600001.csv", sh), ("x/20240102/000001.csv", sz), ("x/20240102/_summary.csv", sh), ("x/notaday/600001.csv", sh), ("x/20240102/000002.csv", ""), ("x/20240102/000003.csv", None)], "path string, content string")
    rows = [(r.security_id, r.file_line, r.UpdateTime, r.LastPrice, r.volume, r.status, r.market) for r in parse_raw(files).orderBy("security_id", "file_line").collect()]
    assert rows == [
        ("000001", 1, "9:31:00", None, None, 'T"0', "SZ"), ("000001", 2, "9:32:00", None, 7.0, "T0", "SZ"),
        ("600001", 1, "9:30:00", 1.5, None, "TRADE", "SH"), ("600001", 3, "9:30:03", None, None, "TRADE", "SH"), ("600001", 4, "9:30:06", None, None, None, "SH"),
    ]


def test_metadata(spark, tmp_path):
    cols = "factor_name,full_name,category,description,formula,formula_latex,windows_min,windows_ticks,inputs,validity_conditions,notes"
    (tmp_path / "m.csv").write_text(cols + '\nbap,"Book, ""pressure""",x,"two\nlines",f,l,1,2,i,v,n\n')
    r = read_metadata(spark, str(tmp_path / "m.csv")).first()
    assert r.full_name == 'Book, "pressure"' and r.description == "two\nlines" and r.notes == "n"


def test_all_stages(spark, raw, tmp_path):
    root = str(tmp_path)
    run = Run(spark, root, PARAMS, factor="bap", windows={"4t": 4, "8t": 8})
    run.sample(str(raw))
    assert run.read("sampled").count() == 2 * 6 * 50
    assert {r.Status for r in run.read("sample_summary").collect()} == {"OK"}
    first = run.read("sampled").filter("security_id = '000001' and tick_idx = 0").first()
    assert first.LastPrice is None and first.security_id == "000001"  # F-28
    run.clean(str(raw / "drop.csv"))
    dropped = {(r.date[-2:], r.security_id): r.drop_reason for r in run.read("dropped").collect()}
    assert dropped == {("03", "000002"): "MANUAL_OVERRIDE", ("02", "600006"): "MANUAL_OVERRIDE", ("03", "600006"): "MANUAL_OVERRIDE", ("02", "300003"): "ALL_DAY_SUSPEND", ("03", "300003"): "ALL_DAY_SUSPEND"}
    run.base()
    assert run.read("base_summary").filter("CanUsePriceTicks = 49").count() == 7
    for stage in ("factors", "cs_ic", "ts_ic", "ic_stats", "cs_quantile"):
        getattr(run, stage)()
    assert run.read("cs_ic_bap").count() == 2 * 50 * 4
    stats = run.read("cs_ic_stats")
    assert stats.count() == 2 * 2 * 3 and {r.factor_window for r in stats.collect()} == {4, 8} and stats.filter("n_days <> 2").count() == 0
    assert run.ic_plot().count() == 24 and run.cs_quantile_chart().count() == 2 * 50 * 2
    mom = Run(spark, root, PARAMS, factor="mom", windows={"3t": 3})
    for stage in ("factors", "cs_ic", "ts_ic", "ic_stats"):
        getattr(mom, stage)()
    assert {r.factor_name for r in run.read("cs_ic_stats").collect()} == {"bap", "mom"}
    run.multi_factor_quantile(0.0)
    assert run.read("weights").count() == 6 and run.read("composite_ret_fwd_1").count() == 100
    assert run.read("composite_ret_fwd_1_cum_daily", True).count() == 2
    # one day again: the other stays
    Run(spark, root, PARAMS, days=["20240103"], factor="bap", windows={"4t": 4, "8t": 8}).factors()
    assert {r[0] for r in available_days(run.read("factor_bap")).collect()} == {"2024-01-02", "2024-01-03"}
    export_csv(run.read("weights"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 6


def test_command_line(spark, raw, tmp_path):
    assert cli.main(["sample", "--root", str(tmp_path), "--raw", str(raw), "--date", "20240102"]) == 0
    assert read_table(spark, str(tmp_path), "sampled").count() == 6 * 4740
    with pytest.raises(SystemExit):
        cli.main(["nothing", "--root", "x"])
    assert cli.parser().parse_args(["factors", "--root", "x"]).factor == "bap" and len(cli.STAGES) == 11 and "bap" in FACTORS


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("a", i, float(i), 1.0) for i in range(10)], "s string, n long, p double, v double").withColumn("ts", F.timestamp_seconds(F.col("n") * 30))
    df.write.parquet(src)
    schema, seen = "s string, n long, p double, v double, ts timestamp", []
    for _ in range(2):
        q = on_new_rows(spark, src, schema, lambda batch, k: seen.append(batch.count()), str(tmp_path / "c1"))
        q.awaitTermination(60)
    assert seen == [10]
    stream = bars(spark.readStream.schema(schema).parquet(src), "ts", "s", "p", "v", "2 minutes", "1 minute")
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = sorted(spark.table("bars").collect(), key=lambda r: r.start)
    assert [(r.open, r.high, r.low, r.close, r.ticks) for r in rows] == [(0.0, 3.0, 0.0, 3.0, 4), (4.0, 7.0, 4.0, 7.0, 4), (8.0, 9.0, 8.0, 9.0, 2)]


def test_all_horizons_and_kinds(spark, raw, tmp_path, monkeypatch):
    root = str(tmp_path)
    run = Run(spark, root, PARAMS, factor="bap", windows={"4t": 4, "8t": 8})
    run.sample(str(raw))
    for stage in ("clean", "base", "factors", "cs_ic", "ts_ic", "ic_stats", "cs_quantile"):
        getattr(run, stage)()
    rets = {"ret_fwd_1", "ret_fwd_2"}
    sums = {}
    for table in ("", "_daily", "_summary", "_cum_tick", "_cum_daily"):
        df = run.read(f"quantile_bap{table}", True)
        assert {r.ret: r.n for r in df.groupBy("ret").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(rets, df.count() // 2)
    for ret in rets:  # the second horizon's portfolios are its own
        sums[ret] = run.read("quantile_bap", True).filter(F.col("ret") == ret).agg(F.sum("g1")).first()[0]
    assert len(set(sums.values())) == 2 and None not in sums.values()
    monkeypatch.setattr(cli, "Run", lambda spark, root, days, factor: Run(spark, root, PARAMS, days, factor))
    for stage in ("ic_plot", "cs_quantile_chart"):
        assert cli.main([stage, "--root", root]) == 0
    chart = run.read("cs_quantile_chart_bap", True)
    assert {(r.ret, r["count"]) for r in chart.groupBy("ret").count().collect()} == {(r, 200) for r in rets}
    assert chart.filter("x > 99").count() == 0
    lines = run.read("ic_plot_bap", True)
    assert {(r.ic_type, r.ret, r["count"]) for r in lines.groupBy("ic_type", "ret").count().collect()} == {(k, r, 12) for k in ("CS", "TS") for r in rets}
    run.multi_factor_quantile(0.0)
    for ret in rets:
        assert run.read(f"composite_{ret}_chart", True).count() == 100 and run.read(f"composite_{ret}").filter("n_valid > 0").count() > 0
    run.multi_factor_quantile(2.0)  # no factor reaches it: nothing of the run before stays
    for ret in rets:
        assert run.read(f"composite_{ret}").count() == 100 and run.read(f"composite_{ret}").filter("n_valid > 0").count() == 0
        assert run.read(f"composite_{ret}_cum_daily", True).filter("n_ticks > 0").count() == 0


def test_failures_are_data(spark, raw, tmp_path):
    """Broken files among good ones: each has its status, all others are computed; a rerun with a longer list leaves nothing old."""
    import shutil

    files, root = tmp_path / "files", str(tmp_path / "root")
    shutil.copytree(raw, files)
    day = files / "20240102"
    good = (day / "600004.csv").read_text()
    (day / "600010.csv").write_text(good.split("\n")[0] + "\n")
    (day / "600011.csv").write_text("")
    (day / "600012.csv").write_text(good.replace("UpdateTime", "Clock"))
    (day / "600013.csv").write_text(good.replace("InstruStatus", "State"))
    (day / "600014.csv").write_text(good.replace(":", "-"))
    (day / "600015.csv").write_text(good.replace("AskPrice3", "Ask3"))
    (files / "20249999").mkdir()
    (files / "20249999" / "600004.csv").write_text(good)
    run = Run(spark, root, PARAMS, factor="bap", windows={"4t": 4})
    run.sample(str(files))
    status = {(r.date, r.security_id): (r.Status, r.RawRows, r.SampleRows) for r in run.read("sample_summary").collect()}
    at = "2024-01-02"
    assert status[at, "600010"] == ("NO_RAW_DATA", 0, 0) and status[at, "600014"] == ("NO_VALID_TIME", 0, 0)
    assert status[at, "600011"] == ("FAIL: empty file", None, None) and status[at, "600012"] == ("FAIL: no column UpdateTime", None, None)
    assert status["2024-99-99", "600004"][0] == "FAIL: no such day" and status[at, "600013"][0] == "OK" and len(status) == 2 * 6 + 7
    assert {k for k, v in status.items() if v[0] == "OK"} == {(f"2024-01-0{d}", s) for d in (2, 3) for s in IDS} | {(at, "600013"), (at, "600015")}
    run.clean()
    run.base()
    base = {(r.date, r.security_id): (r.Status, r.Rows) for r in run.read("base_summary").collect()}
    assert base[at, "600013"] == ("FAIL: no status column", None) and base[at, "600015"] == ("FAIL: no column AskPrice3", None)
    assert {v for k, v in base.items() if k[1] in ("000001", "600004")} == {("OK", 50)} and run.read("base").select("date", "security_id").distinct().count() == 10
    run.factors()
    assert {(r.Status, r.Rows) for r in run.read("factor_bap_summary").collect()} == {("OK", 50)}
    # days that lost rows or have some twice since they were sampled
    sampled = spark.createDataFrame(run.read("sampled").collect(), run.read("sampled").schema)
    lost = sampled.filter(~((F.col("security_id") == "000001") & (F.col("date") == at)))
    twice = sampled.filter((F.col("security_id") == "600005") & (F.col("date") == at) & (F.col("tick_idx") == 7))
    run.write(lost.unionByName(twice), "sampled")
    run.clean()
    reasons = {(r.date, r.security_id): r.drop_reason for r in run.read("dropped").collect()}
    assert reasons[at, "000001"] == "EMPTY_FILE" and reasons[at, "600005"].startswith("ERROR") and reasons[at, "300003"] == "ALL_DAY_SUSPEND" and len(reasons) == 4
    (files / "drop.csv").write_text("20240102,ALL,gone\n")
    again = Run(spark, root, PARAMS, days=["20240102"], factor="bap", windows={"4t": 4})
    again.clean(str(files / "drop.csv"))
    again.base()
    assert {r.date for r in run.read("cleaned").select("date").distinct().collect()} == {"2024-01-03"} == {r.date for r in run.read("base").select("date").distinct().collect()}
    assert again.read("cleaned").count() == 0 and {r.drop_reason for r in again.read("dropped").collect()} == {"MANUAL_OVERRIDE"}
