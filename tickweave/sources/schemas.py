"""Schemas of the tick pipeline's inputs."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = range(1, 6)
BOOK = [f"{side}{what}{i}" for side in ("Ask", "Bid") for what in ("Price", "Volume") for i in LEVELS]


#: The columns of a raw snapshot file; the markets name their volume and status differently: TradVolume and InstruStatus are SH's.
RAW_COLUMNS = ["Date", "UpdateTime", "PreCloPrice", "LastPrice", "Turnover", "TradVolume", "InstruStatus", "Volume", "TradingPhaseCode", *BOOK]

#: What a raw file can't do without: its time on the grid, the book for prices (in the order in which stages ask for them). The status is told by `market`.
NEEDED = ["UpdateTime", "BidPrice1", "AskPrice1", "BidVolume1", "AskVolume1", *[c for c in BOOK if c[-1] != "1"]]


METADATA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in "factor_name full_name category description formula formula_latex windows_min windows_ticks inputs validity_conditions notes".split()
    ]
)
