"""Tables that look like ticks or panels, made of the tables at hand, so that every operator has real input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions.along import tasks_for
from tickweave.functions.exprs import div, flag, tidy
from tickweave.operators.base import with_base
from tickweave.operators.ingest import as_of
from tickweave.sources.schemas import BOOK, LEVELS

DAY = ("date", "security_id")
ORDER = "tick_idx"
FACTORS = ["alpha_1m", "alpha_2m", "alpha_3m"]
RETURNS = ["ret_1", "ret_2"]
AM_END, PM_START = "06", "07"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- T: events as ticks on an hourly grid


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tick for each event: a made-up five-level book around its value."""
    e = table(spark, sf_dir, "events")
    no_bid = flag((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0))
    no_ask = flag((F.col("event_type") == "view") & (F.col("event_id") % 7 == 0))
    book = {}
    for i in LEVELS:
        book[f"AskPrice{i}"] = F.col("value") + F.lit(0.01 * i)
        book[f"BidPrice{i}"] = F.col("value") - F.lit(0.01 * i)
        book[f"AskVolume{i}"] = F.when(no_ask, 0.0).otherwise((1 + (F.col("event_id") * 11 + i * 17) % 50).cast("double"))
        book[f"BidVolume{i}"] = F.when(no_bid, 0.0).otherwise((1 + (F.col("event_id") * 7 + i * 13) % 50).cast("double"))
    status = F.when(F.col("event_type") == "signup", "HALT").otherwise("TRADE")
    return e.select(F.col("user_id").alias("security_id"), "ts", "event_id", "event_type", "value", F.lit("SH").alias("market"), status.alias("status"), *[c.alias(k) for k, c in book.items()])


def hourly_grid(ticks: DataFrame) -> DataFrame:
    """Every security's hours, from the first day's first to the last day's last."""
    low, high = ticks.agg(F.min("ts").cast("timestamp_ntz"), F.max("ts").cast("timestamp_ntz")).first()
    securities = ticks.select("security_id").distinct()
    if low is None:
        return securities.select("security_id", F.lit(None).cast("timestamp_ntz").alias("grid_ts")).limit(0)
    first = F.lit(f"{low:%Y-%m-%d} 00:00:00").cast("timestamp_ntz")
    last = F.lit(f"{high:%Y-%m-%d} 23:00:00").cast("timestamp_ntz")
    return securities.select("security_id", F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("grid_ts"))


def event_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for every security's hours and its ticks."""
    low, high, securities, n = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts"), F.approx_count_distinct("user_id"), F.count("*")).first()
    return tasks_for(spark, n + (securities * 24 * ((high.date() - low.date()).days + 1) if n and low else 0))


def sampled_events(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Each hour with the latest tick (or some columns of it); date, sample_time and tick_idx (the hour) as in a day of ticks."""
    ticks = event_ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    sampled = as_of(hourly_grid(ticks), ticks, ["security_id"], "grid_ts", "ts", columns=columns, tasks=event_tasks(spark, sf_dir))
    return sampled.select(
        F.date_format("grid_ts", "yyyy-MM-dd").alias("date"), F.date_format("grid_ts", "HH:mm:ss").alias("sample_time"), F.hour("grid_ts").alias("tick_idx"), "*"
    ).withColumn("market", F.lit("SH"))


def event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_base(sampled_events(spark, sf_dir, ["status", *BOOK]))


# ---- S: a supplier's line items as one long row of ticks


def item_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    items = items.repartition(tasks_for(spark, items.count()), "l_suppkey")
    order = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    usable = flag(F.col("l_quantity") > 2)
    numbered = items.select(
        F.lit("all").alias("date"), F.col("l_suppkey").alias("security_id"), (F.row_number().over(order) - 1).alias("tick_idx"),
        div(F.col("l_extendedprice"), F.col("l_quantity")).alias("Price"), usable.alias("CanUsePrice"),
        (usable & (F.col("l_partkey") % 40 != 0)).alias("CanUseDoubleSideBook"),
        F.sum("l_quantity").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("CumVolume"),
    )
    return numbered.withColumn("Price", F.when(F.col("CanUsePrice"), F.col("Price")))


# ---- L: the line items of ten groups of suppliers as ten long rows of ticks, with a book, for windows as they are shipped


def long_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 2,500 rows there is a stretch of forty rows most of which cannot be used, else only single rows lack a side or a level of the book.

    Rows are numbered within a security's day and moved by what its days before hold, so that no task has a whole security.
    """
    items = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(spark, items.count())
    items = items.select(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity",
        (F.col("l_suppkey") % 10).alias("security_id"), F.to_date("l_shipdate").alias("day"), tidy(div(F.col("l_extendedprice"), F.col("l_quantity"))).alias("p"),
    )
    earlier = W.partitionBy("of").orderBy("on").rowsBetween(W.unboundedPreceding, -1)
    days = items.groupBy(F.col("security_id").alias("of"), F.col("day").alias("on")).agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"))
    days = days.select("of", "on", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.sum("quantity").over(earlier).alias("before"))
    order = W.partitionBy("security_id", "day").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    numbered = items.repartition(tasks, "security_id", "day").withColumns({"at": F.row_number().over(order) - 1, "so_far": F.sum("l_quantity").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))})
    numbered = numbered.join(F.broadcast(days), F.col("security_id").eqNullSafe(F.col("of")) & F.col("day").eqNullSafe(F.col("on")))
    numbered = numbered.withColumns({"tick_idx": (F.col("rows_before") + F.col("at")).cast("int"), "CumVolume": F.coalesce(F.col("before") + F.col("so_far"), "before", "so_far")})
    usable = ~((F.col("tick_idx") % 2500 < 40) & (F.col("l_partkey") % 3 != 0))
    both = usable & (F.col("l_partkey") % 40 != 0)
    book = {}
    for i in LEVELS:
        book[f"AskPrice{i}"] = F.col("p") + F.lit(0.01 * i) + (F.col("l_partkey") % (i + 3)) * F.lit(0.001)
        book[f"BidPrice{i}"] = F.col("p") - F.lit(0.01 * i) - (F.col("l_orderkey") % (i + 2)) * F.lit(0.001)
        book[f"AskVolume{i}"] = (1 + (F.col("l_orderkey") * 11 + i * 17) % 50).cast("double")
        book[f"BidVolume{i}"] = (1 + (F.col("l_partkey") * 7 + i * 13) % 50).cast("double")
    return numbered.select(
        F.lit("all").alias("date"), "security_id", "tick_idx", F.col("tick_idx").alias("_pos"), "CumVolume", usable.alias("CanUsePrice"), both.alias("CanUseDoubleSideBook"),
        (both & (F.col("l_orderkey") % 30 != 0)).alias("CanUseFiveLevelBook"), F.when(usable, F.col("p")).alias("Price"), *[c.alias(k) for k, c in book.items()],
    )


# ---- R: events as raw files of both markets


RAW_HEADS = {
    "SH": ["Date", "UpdateTime", "SecurityID", "LastPrice", "TradVolume", "InstruStatus", "AskPrice1", "BidVolume5"],
    "SZ": ["SecurityID", "BidVolume5", "AskPrice1", "TradingPhaseCode", "Volume", "LastPrice", "UpdateTime", "Date"],
}


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file for each user and day, in either market's dialect; some times are no times, some lines come twice in changed form,
    the second market's columns stand the other way round, in quotes, with a carriage return."""
    e = table(spark, sf_dir, "events").withColumn("again", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    sh = F.col("user_id") % 2 == 1
    day, security = F.date_format("ts", "yyyyMMdd"), F.lpad(F.col("user_id").cast("string"), 6, "0")
    time = F.when(F.col("event_id") % 13 == 0, "nan").when(F.col("event_id") % 17 == 0, "24:00:00").otherwise(F.concat(F.lit(" "), F.date_format("ts", "HH:mm:ss.SSSSSS")))
    status = F.when(sh, "TRADE").otherwise("T0")
    price = (F.col("value") * 100).cast("long").cast("string")
    cell = {"Date": day, "UpdateTime": time, "SecurityID": F.col("user_id").cast("string"), "LastPrice": F.when(F.col("again") == 1, F.lit("")).otherwise(price),
            "Volume": (F.col("event_id") % 1000).cast("string"), "Status": status, "AskPrice1": F.concat(price, F.lit(".5")), "BidVolume5": F.lit("7,0")}
    own = lambda c: cell["Volume" if "Vol" in c and c != "BidVolume5" else "Status" if c in ("InstruStatus", "TradingPhaseCode") else c]
    line_sh = F.concat_ws(",", *[F.when(F.lit(c == "BidVolume5"), F.lit("70")).otherwise(own(c)) for c in RAW_HEADS["SH"]])
    line_sz = F.concat(F.concat_ws(",", *[F.concat(F.lit('"'), own(c), F.lit('"')) for c in RAW_HEADS["SZ"]]), F.lit("\r"))
    lines = e.select(sh.alias("sh"), day.alias("day"), security.alias("sec"), F.struct("ts", "event_id", "again", F.when(sh, line_sh).otherwise(line_sz).alias("line")).alias("l"))
    files = lines.groupBy("sh", "day", "sec").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    head = F.when(F.col("sh"), F.lit("\ufeff" + ",".join(RAW_HEADS["SH"]))).otherwise(F.lit(",".join(RAW_HEADS["SZ"]) + "\r"))
    return files.select(F.concat(F.lit("data/"), "day", F.lit("/"), "sec", F.lit(".csv")).alias("path"), F.concat(head, F.lit("\n"), F.concat_ws("\n", F.transform("ls", lambda x: x["line"])), F.lit("\n")).alias("content"))


# ---- F: events as whole raw files, some of them broken


FULL_HEADS = {
    "SH": ["Date", "UpdateTime", "SecurityID", "PreCloPrice", "LastPrice", "Turnover", "TradVolume", "InstruStatus", *BOOK],
    "SZ": ["SecurityID", *reversed(BOOK), "TradingPhaseCode", "Volume", "LastPrice", "PreCloPrice", "Turnover", "UpdateTime", "Date"],
}
BROKEN = 9  # by day of the month plus user: header alone, nothing, no column of times, no status, no time, no column of the book; the others are whole


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file for each user and day of events with a whole book; six in nine are broken, each in its way."""
    e = table(spark, sf_dir, "events")
    sh, cents = F.col("user_id") % 2 == 1, (F.col("value") * 100).cast("long")
    no_bid = flag((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0))
    no_ask = flag((F.col("event_type") == "view") & (F.col("event_id") % 7 == 0))
    halted = F.col("event_type") == "signup"
    status = F.when(sh, F.when(halted, "HALT").otherwise("TRADE")).otherwise(F.when(halted, "H0").otherwise("T0"))
    cell = {"Date": F.date_format("ts", "yyyyMMdd"), "UpdateTime": F.date_format("ts", "HH:mm:ss.SSSSSS"), "SecurityID": F.col("user_id").cast("string"), "PreCloPrice": F.lit("100"),
            "LastPrice": cents.cast("string"), "Turnover": F.lit("1"), "TradVolume": F.col("event_id").cast("string"), "Volume": F.col("event_id").cast("string"),
            "InstruStatus": status, "TradingPhaseCode": status}
    for i in LEVELS:
        cell |= {f"AskPrice{i}": (cents + i).cast("string"), f"BidPrice{i}": (cents - i).cast("string")}
        cell[f"AskVolume{i}"] = F.when(no_ask, 0).otherwise(1 + (F.col("event_id") * 11 + i * 17) % 50).cast("string")
        cell[f"BidVolume{i}"] = F.when(no_bid, 0).otherwise(1 + (F.col("event_id") * 7 + i * 13) % 50).cast("string")
    line = F.when(sh, F.concat_ws(",", *[cell[c] for c in FULL_HEADS["SH"]])).otherwise(F.concat_ws(",", *[cell[c] for c in FULL_HEADS["SZ"]]))
    lines = e.select(sh.alias("sh"), cell["Date"].alias("day"), F.lpad(cell["SecurityID"], 6, "0").alias("sec"), F.struct("ts", "event_id", line.alias("line")).alias("l"))
    files = lines.groupBy("sh", "day", "sec").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    head = F.when(F.col("sh"), ",".join(FULL_HEADS["SH"])).otherwise(",".join(FULL_HEADS["SZ"]))
    content = F.concat(head, F.lit("\n"), F.concat_ws("\n", F.transform("ls", lambda x: x["line"])), F.lit("\n"))
    kind = (F.substring("day", 7, 2).cast("int") + F.col("sec").cast("int")) % BROKEN
    renamed = lambda *pairs: reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, content)
    content = (
        F.when(kind == 0, F.concat(head, F.lit("\n"))).when(kind == 1, "").when(kind == 2, renamed(("UpdateTime", "Clock")))
        .when(kind == 3, renamed(("InstruStatus", "State"), ("TradingPhaseCode", "State"))).when(kind == 4, renamed((":", "-"))).when(kind == 5, renamed(("AskPrice1", "Ask"))).otherwise(content)
    )
    return files.select(F.concat(F.lit("data/"), "day", F.lit("/"), "sec", F.lit(".csv")).alias("path"), content.alias("content"))


# ---- P: a monthly panel of suppliers


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    monthly = items.groupBy(F.date_format("l_shipdate", "yyyy").alias("date"), F.date_format("l_shipdate", "MM").alias("sample_time"), F.col("l_suppkey").alias("security_id")).agg(
        tidy(F.avg(div(F.col("l_extendedprice"), F.col("l_quantity")))).alias("price"),
        tidy(F.avg("l_discount")).alias("alpha_1m"), tidy(F.sum("l_quantity")).alias("alpha_2m"), tidy(F.avg("l_tax")).alias("alpha_3m"), F.count("*").alias("items"),
    )
    months = W.partitionBy("security_id").orderBy("date", "sample_time")
    limit = {f"{f}_has_limit": F.col("items") % (k + 5) == 0 for k, f in enumerate(FACTORS)}
    gone = F.when(F.col("items") % 9 != 1, F.col("alpha_3m"))
    returns = {f"ret_{h}": div(F.lead("price", h).over(months), F.col("price")) - 1 for h in (1, 2)}
    return monthly.withColumn("alpha_3m", gone).withColumns({**limit, **returns})
