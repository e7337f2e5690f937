"""Prices and validity masks from the order book (OP-29 to OP-37), forward returns and limit ticks (OP-38, OP-39)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.exprs import all_of, div, flag
from tickweave.functions.windows import rows_of
from tickweave.sources.schemas import BOOK, LEVELS

ask = lambda i: F.col(f"AskPrice{i}")
bid = lambda i: F.col(f"BidPrice{i}")
ask_volume = lambda i: F.col(f"AskVolume{i}")
bid_volume = lambda i: F.col(f"BidVolume{i}")


def trade_like(market: Column, status: Column) -> Column:
    """OP-29: NULL where the market, and so the status, is unknown."""
    s = F.trim(status)
    return F.when(market == "SH", flag(s == "TRADE")).when(market == "SZ", flag((F.substring(s, 1, 1) == "T") & (F.substring(s, 2, 1) != "1")))


def side_exists(price: Column, volume: Column) -> Column:
    """OP-30."""
    return flag((price > 0) & (volume > 0))


def double_side() -> Column:
    """OP-31."""
    return side_exists(bid(1), bid_volume(1)) & side_exists(ask(1), ask_volume(1)) & flag(bid(1) <= ask(1))


def five_levels() -> Column:
    """OP-32: all there and in order; only the first level needs to be above zero."""
    there = all_of(*[F.col(c).isNotNull() for c in BOOK])
    ordered = all_of(*[(ask(i) <= ask(i + 1)) & (bid(i) >= bid(i + 1)) for i in LEVELS[:-1]])
    return double_side() & there & flag(ordered)


def reverse_mid() -> Column:
    """OP-33: each side's price weighted by the other side's volume."""
    return div(bid(1) * ask_volume(1) + ask(1) * bid_volume(1), bid_volume(1) + ask_volume(1))


def with_base(ticks: DataFrame) -> DataFrame:
    """OP-29 to OP-36: add PriceType, Price and the masks; a tick without a known market can't be used (base_status says so)."""
    trade = flag(trade_like(F.col("market"), F.col("status")))
    has_bid, has_ask = side_exists(bid(1), bid_volume(1)), side_exists(ask(1), ask_volume(1))
    kind = F.when(
        F.col("_trade"),
        F.when(F.col("_double"), "NORMAL_WMID").when(has_ask & ~has_bid, "LIMIT_DOWN_ONE_SIDED").when(has_bid & ~has_ask, "LIMIT_UP_ONE_SIDED"),
    )
    kind = F.coalesce(kind, F.lit("INVALID"))
    price = F.when(F.col("PriceType") == "NORMAL_WMID", reverse_mid()).when(F.col("PriceType") == "LIMIT_DOWN_ONE_SIDED", ask(1)).when(F.col("PriceType") == "LIMIT_UP_ONE_SIDED", bid(1))
    masked = ticks.withColumns({"_trade": trade, "_double": double_side()}).withColumn("PriceType", kind).withColumn("Price", price)
    return masked.withColumns(
        {
            "CanUsePrice": F.col("_trade") & F.col("Price").isNotNull(),
            "CanUseDoubleSideBook": F.col("_trade") & F.col("_double"),
            "CanUseFiveLevelBook": F.col("_trade") & five_levels(),
        }
    ).drop("_trade", "_double")


def base_status(ticks: DataFrame, by: list[str], order: str = "tick_idx") -> DataFrame:
    """(by, market, Status): a day's market, and OK, or FAIL and why: no status column, no column of the book.

    Nothing raises: what fails has its status, everything else is computed.
    """
    own = F.first(F.when(F.col("market") != "UNK", F.col("market")), ignorenulls=True)
    lacks = F.max("lacks") if "lacks" in ticks.columns else F.lit(None).cast("string")
    found = ticks.groupBy(*by).agg(own.alias("market"), lacks.alias("_lacks"))
    status = F.when(F.col("market").isNull(), "FAIL: no status column").when(F.col("_lacks").isNotNull(), F.concat(F.lit("FAIL: no column "), "_lacks")).otherwise("OK")
    return found.withColumn("Status", status).drop("_lacks")


def with_status(summary: DataFrame, statuses: DataFrame, by: list[str]) -> DataFrame:
    """A summary's rows with the Status of each of by; those that failed have no counts."""
    names = [c for c in summary.columns if c not in by]
    return statuses.select(*by, "Status").join(summary, by, "left").select(*by, "Status", *names)


def base_summary(base: DataFrame, by: list[str]) -> DataFrame:
    """OP-37."""
    of_type = lambda t: F.count_if(F.col("PriceType") == t)
    return base.groupBy(*by).agg(
        F.count("*").alias("Rows"),
        of_type("NORMAL_WMID").alias("NormalWmidTicks"),
        of_type("LIMIT_DOWN_ONE_SIDED").alias("LimitDownTicks"),
        of_type("LIMIT_UP_ONE_SIDED").alias("LimitUpTicks"),
        F.count_if("CanUsePrice").alias("CanUsePriceTicks"),
        F.count_if("CanUseDoubleSideBook").alias("CanUseDoubleTicks"),
        F.count_if("CanUseFiveLevelBook").alias("CanUseFiveTicks"),
    )


def limit_tick() -> Column:
    """OP-39."""
    return F.col("CanUsePrice") & ~F.col("CanUseDoubleSideBook")


def with_forward_returns(base: DataFrame, horizons: tuple[int, ...], by: list[str], order: str) -> DataFrame:
    """OP-38: ret_fwd_h, by rows within by, where both ends can be used."""
    rows = rows_of(by, order)

    def one(h: int) -> Column:
        usable = F.col("CanUsePrice") & flag(F.lead("CanUsePrice", h).over(rows))
        return F.when(usable, div(F.lead("Price", h).over(rows), F.col("Price")) - 1)

    return base.withColumns({f"ret_fwd_{h}": one(h) for h in horizons})
