"""The same queries as DuckDB SQL, written plainly: ordinary frames, self-joins and built-in statistics instead of running sums."""

from __future__ import annotations

FACTORS = ["alpha_1m", "alpha_2m", "alpha_3m"]
RETURNS = ["ret_1", "ret_2"]
SQL: dict[str, str] = {}


def r6(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x} + 1e-10, {digits}) + 0.0 AS {name or x}"


def r6s(*names: str) -> str:
    return ", ".join(r6(n) for n in names)


BOOK = ", ".join(
    f"value + {0.01 * i!r} AS a{i}, value - {0.01 * i!r} AS b{i}, "
    f"CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN 0.0 ELSE CAST(1 + (event_id * 11 + {i * 17}) % 50 AS DOUBLE) END AS av{i}, "
    f"CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 0.0 ELSE CAST(1 + (event_id * 7 + {i * 13}) % 50 AS DOUBLE) END AS bv{i}"
    for i in range(1, 6)
)
SAMPLED = f"""
bounds AS (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) + INTERVAL 23 HOUR AS hi FROM events),
hours AS (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 HOUR)) AS grid_ts FROM bounds),
grid AS (SELECT security_id, grid_ts FROM (SELECT DISTINCT user_id AS security_id FROM events), hours),
book AS (SELECT user_id, ts, event_id, value, CASE WHEN event_type = 'signup' THEN 'HALT' ELSE 'TRADE' END AS status, {BOOK} FROM events),
sampled AS (
  SELECT g.security_id, g.grid_ts, strftime(g.grid_ts, '%Y-%m-%d') AS date, strftime(g.grid_ts, '%H:%M:%S') AS sample_time,
         CAST(hour(g.grid_ts) AS INT) AS tick_idx, book.*, date_diff('microsecond', book.ts, g.grid_ts) / 1e6 AS gap_sec
  FROM grid g ASOF LEFT JOIN book ON g.security_id = book.user_id AND g.grid_ts >= book.ts
)"""
BASE = SAMPLED + f""",
marked AS (
  SELECT *, coalesce(status = 'TRADE', false) AS trade,
         coalesce(b1 > 0 AND bv1 > 0, false) AS has_bid, coalesce(a1 > 0 AND av1 > 0, false) AS has_ask FROM sampled
), sided AS (
  SELECT *, has_bid AND has_ask AND coalesce(b1 <= a1, false) AS two FROM marked
), typed AS (
  SELECT *, CASE WHEN trade AND two THEN 'NORMAL_WMID' WHEN trade AND has_ask AND NOT has_bid THEN 'LIMIT_DOWN_ONE_SIDED'
                 WHEN trade AND has_bid AND NOT has_ask THEN 'LIMIT_UP_ONE_SIDED' ELSE 'INVALID' END AS PriceType FROM sided
), priced AS (
  SELECT *, CASE PriceType WHEN 'NORMAL_WMID' THEN (b1 * av1 + a1 * bv1) / (bv1 + av1) WHEN 'LIMIT_DOWN_ONE_SIDED' THEN a1
                           WHEN 'LIMIT_UP_ONE_SIDED' THEN b1 END AS Price FROM typed
), base AS (
  SELECT *, trade AND Price IS NOT NULL AS CanUsePrice, trade AND two AS CanUseDoubleSideBook,
         trade AND two AND {" AND ".join(f"{c}{i} IS NOT NULL" for c in ("a", "b", "av", "bv") for i in range(1, 6))}
         AND {" AND ".join(f"a{i} <= a{i + 1} AND b{i} >= b{i + 1}" for i in range(1, 5))} AS CanUseFiveLevelBook
  FROM priced
)"""
DAY = "PARTITION BY date, security_id ORDER BY tick_idx"

SQL["resample_grid"] = f"WITH {SAMPLED} SELECT security_id, strftime(grid_ts, '%Y-%m-%d %H:%M:%S') AS grid_ts FROM grid"
SQL["session_grid"] = """
WITH days AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events),
grid AS (SELECT day, unnest(generate_series(CAST(day AS TIMESTAMP) + INTERVAL '09:30:00' HOUR, CAST(day AS TIMESTAMP) + INTERVAL '11:29:57' HOUR, INTERVAL 3 SECOND)) AS ts FROM days
         UNION ALL SELECT day, unnest(generate_series(CAST(day AS TIMESTAMP) + INTERVAL '13:00:00' HOUR, CAST(day AS TIMESTAMP) + INTERVAL '14:56:57' HOUR, INTERVAL 3 SECOND)) FROM days)
SELECT strftime(day, '%Y%m%d') AS day, count(*) AS ticks, CAST(count(*) - 1 AS INT) AS last_idx, strftime(min(ts), '%H:%M:%S') AS first, strftime(max(ts), '%H:%M:%S') AS last FROM grid GROUP BY day
""".replace("INTERVAL '09:30:00' HOUR", "INTERVAL 34200 SECOND").replace("INTERVAL '11:29:57' HOUR", "INTERVAL 41397 SECOND").replace("INTERVAL '13:00:00' HOUR", "INTERVAL 46800 SECOND").replace("INTERVAL '14:56:57' HOUR", "INTERVAL 53817 SECOND")
SQL["keep_last"] = f"""
SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS hour, arg_max(event_id, (ts, event_id)) AS event_id, {r6("arg_max(value, (ts, event_id))", "value")} FROM events GROUP BY 1, 2"""
SQL["as_of_join"] = f"WITH {SAMPLED} SELECT security_id, date, sample_time, tick_idx, event_id, {r6('value')}, {r6('b1', 'BidPrice1')}, {r6('av3', 'AskVolume3')}, {r6('gap_sec')} FROM sampled"
SUMMARY = SAMPLED + """,
raws AS (SELECT user_id AS security_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1, 2),
summed AS (
  SELECT security_id, date, count(*) AS SampleRows, round_even(max(gap_sec), 1) AS MaxGapSec, round_even(avg(gap_sec), 1) AS MeanGapSec,
         round_even(avg(CASE WHEN gap_sec > 36000 THEN 1.0 ELSE 0.0 END), 4) AS PctGapGt60, max(gap_sec) AS top FROM sampled GROUP BY 1, 2
), summary AS (
  SELECT security_id, date, coalesce(n, 0) AS RawRows, SampleRows, MaxGapSec, MeanGapSec, PctGapGt60,
         CASE WHEN coalesce(n, 0) = 0 THEN 'NO_VALID_TIME' WHEN top <= 36000 THEN 'OK' ELSE 'LARGE_GAP' END AS Status
  FROM summed LEFT JOIN raws USING (security_id, date)
)"""
SQL["resample_summary"] = f"WITH {SUMMARY} SELECT security_id, date, RawRows, SampleRows, {r6s('MaxGapSec', 'MeanGapSec', 'PctGapGt60')}, Status FROM summary"
SQL["gap_review"] = f"WITH {SUMMARY} SELECT security_id, date, {r6('MaxGapSec')} FROM summary WHERE security_id % 3 <> 0 AND MaxGapSec > 36000"

STATUSES = """
statuses AS (
  SELECT event_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS security_id, strftime(ts, '%Y%m%d') AS day,
         CASE WHEN user_id % 2 = 0 THEN ['T0', 'T1', 'O0', 'C0', 'H0'][event_id % 5 + 1] ELSE ['TRADE', 'OCALL', 'HALT', ' TRADE '][event_id % 4 + 1] END AS status,
         user_id % 2 = 0 AS sz FROM events
), classed AS (
  SELECT *, CASE WHEN trim(status) IN ('T0', 'TRADE') THEN 'TradeLike' WHEN trim(status) IN ('O0', 'C0', 'OCALL') THEN 'AuctionLike' ELSE 'SuspendLike' END AS tick_class FROM statuses
), lists AS (
  SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'ALL' ELSE '202401' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') END AS on_day,
         CASE WHEN n_nationkey % 9 = 1 THEN 'ALL_SZ' ELSE CAST(n_nationkey AS VARCHAR) END AS security FROM nation
), days AS (
  SELECT day, security_id, count(*) AS rows, bool_and(tick_class = 'SuspendLike') AS all_suspended FROM classed GROUP BY 1, 2
), decided AS (
  SELECT *, EXISTS (SELECT 1 FROM lists WHERE on_day IN ('ALL', day) AND (
      (security = 'ALL_SZ' AND substr(security_id, 1, 1) IN ('0', '3')) OR lpad(security, 6, '0') = security_id)) AS overridden FROM days
), dropped AS (
  SELECT *, CASE WHEN overridden THEN 'MANUAL_OVERRIDE' WHEN rows = 0 THEN 'EMPTY_FILE' WHEN all_suspended THEN 'ALL_DAY_SUSPEND' END AS drop_reason FROM decided
)"""
SQL["tick_status"] = f"WITH {STATUSES} SELECT event_id, tick_class FROM classed"
SQL["screen_days"] = f"WITH {STATUSES} SELECT day, security_id, rows, all_suspended, overridden, drop_reason FROM dropped"
SQL["screen_kept_ticks"] = f"WITH {STATUSES} SELECT event_id, s.day, s.security_id FROM statuses s JOIN dropped d ON s.day = d.day AND s.security_id = d.security_id WHERE drop_reason IS NULL"
SQL["screen_dropped"] = f"WITH {STATUSES} SELECT day, security_id, drop_reason FROM dropped WHERE drop_reason IS NOT NULL"
SQL["screen_reason_counts"] = f"WITH {STATUSES} SELECT drop_reason, count(*) AS n FROM dropped WHERE drop_reason IS NOT NULL GROUP BY 1"

SQL["base_ticks"] = f"WITH {BASE} SELECT security_id, date, sample_time, PriceType, {r6('Price')}, CanUsePrice, CanUseDoubleSideBook, CanUseFiveLevelBook FROM base"
SQL["base_summary"] = f"""WITH {BASE} SELECT security_id, date, count(*) AS Rows,
  count(*) FILTER (PriceType = 'NORMAL_WMID') AS NormalWmidTicks, count(*) FILTER (PriceType = 'LIMIT_DOWN_ONE_SIDED') AS LimitDownTicks,
  count(*) FILTER (PriceType = 'LIMIT_UP_ONE_SIDED') AS LimitUpTicks, count(*) FILTER (CanUsePrice) AS CanUsePriceTicks,
  count(*) FILTER (CanUseDoubleSideBook) AS CanUseDoubleTicks, count(*) FILTER (CanUseFiveLevelBook) AS CanUseFiveTicks FROM base GROUP BY 1, 2"""
_ret = lambda h: f"CASE WHEN CanUsePrice AND lead(CanUsePrice, {h}) OVER ({DAY}) THEN lead(Price, {h}) OVER ({DAY}) / Price - 1 END"
SQL["forward_returns"] = f"WITH {BASE} SELECT security_id, date, sample_time, {', '.join(r6(_ret(h), f'ret_fwd_{h}') for h in (1, 2, 3))} FROM base"


# ---- factors


def frame(w: int) -> str:
    return f"({DAY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def full(mask: str, w: int) -> str:
    """The window is full and at most a tenth of it is not valid."""
    f = frame(w)
    return f"(count(*) OVER {f} = {w} AND 10 * sum(CASE WHEN {mask} THEN 0 ELSE 1 END) OVER {f} <= {w})"


def limits(w: int) -> str:
    return f"coalesce(bool_or(CanUsePrice AND NOT CanUseDoubleSideBook) OVER {frame(w)}, false)"


T_WINDOWS = (4, 6, 12)


def means(name: str, windows: dict[str, int], digits: int = 6) -> str:
    out = []
    for label, w in windows.items():
        ok = full("raw IS NOT NULL", w)
        out += [r6(f"CASE WHEN {ok} THEN avg(raw) OVER {frame(w)} END", f"{name}_{label}", digits), f"{ok} AND {limits(w)} AS {name}_{label}_has_limit"]
    return ", ".join(out)


def mean_factor(name: str, raw: str) -> str:
    return f"WITH {BASE}, raws AS (SELECT *, {raw} AS raw FROM base) SELECT security_id, date, sample_time, {means(name, {f'{w}t': w for w in T_WINDOWS})} FROM raws"


BAP = "CASE WHEN CanUseDoubleSideBook AND bv1 + av1 > 1e-12 THEN (bv1 - av1) / (bv1 + av1) END"
SQL["factor_bap"] = mean_factor("bap", BAP)
_w = [1.0, 0.8, 0.6, 0.4, 0.2]
_over = " + ".join(f"CAST({w} AS DOUBLE) * (bv{i} - av{i})" for i, w in enumerate(_w, 1))
_under = " + ".join(f"CAST({w} AS DOUBLE) * (bv{i} + av{i})" for i, w in enumerate(_w, 1))
OIR = f"CASE WHEN CanUseFiveLevelBook AND {_under} > 1e-12 THEN ({_over}) / ({_under}) END"
SQL["factor_oir"] = mean_factor("oir", OIR)
_ofd = lambda side, sign: f"(({' + '.join(f'{side}v{i}' for i in range(1, 6))}) / ({sign} * (({side}1 - {side}5) / 4)))"
OFD = f"CASE WHEN CanUseFiveLevelBook AND b1 - b5 > 4e-12 AND a5 - a1 > 4e-12 AND {_ofd('a', '-1')} > 1e-12 THEN {_ofd('b', '1')} / {_ofd('a', '-1')} END"
SQL["factor_ofd"] = mean_factor("ofd", OFD)


def momentum(windows: dict[str, int]) -> str:
    out = []
    for label, w in windows.items():
        v = f"CASE WHEN CanUsePrice AND lag(CanUsePrice, {w}) OVER ({DAY}) THEN ln(Price) - ln(lag(Price, {w}) OVER ({DAY})) END"
        hit = f"(CanUsePrice AND NOT CanUseDoubleSideBook) OR coalesce(lag(CanUsePrice AND NOT CanUseDoubleSideBook, {w}) OVER ({DAY}), false)"
        out += [r6(v, f"mom_{label}"), f"coalesce(({v}) IS NOT NULL AND ({hit}), false) AS mom_{label}_has_limit"]
    return ", ".join(out)


SQL["factor_mom"] = f"WITH {BASE} SELECT security_id, date, sample_time, {momentum({f'{w}t': w for w in T_WINDOWS})} FROM base"


def acceleration(pairs: list[tuple[int, int]]) -> str:
    out = []
    for s, l in pairs:
        near, far = f"lag(Price, {s}) OVER ({DAY})", f"lag(Price, {l}) OVER ({DAY})"
        usable = f"CanUsePrice AND lag(CanUsePrice, {s}) OVER ({DAY}) AND lag(CanUsePrice, {l}) OVER ({DAY})"
        v = f"CASE WHEN {usable} THEN ln(Price) - 2 * ln({near}) + ln({far}) END"
        lim = lambda k: f"lag(CanUsePrice AND NOT CanUseDoubleSideBook, {k}) OVER ({DAY})"
        out += [r6(v, f"acc_mom_{s}_{l}t"), f"coalesce(({v}) IS NOT NULL AND ((CanUsePrice AND NOT CanUseDoubleSideBook) OR {lim(s)} OR {lim(l)}), false) AS acc_mom_{s}_{l}t_has_limit"]
    return ", ".join(out)


SQL["factor_acc_mom"] = f"WITH {BASE} SELECT security_id, date, sample_time, {acceleration([(2, 4), (4, 8)])} FROM base"

_price = lambda s: f"({' + '.join(f'{s}{i} * {s}v{i}' for i in range(1, 6))}) / nullif({' + '.join(f'{s}v{i}' for i in range(1, 6))}, 0)"
XY = f"xy AS (SELECT *, CASE WHEN CanUseFiveLevelBook THEN {_price('b')} END AS x, CASE WHEN CanUseFiveLevelBook THEN {_price('a')} END AS y FROM base)"


def slopes(windows: dict[str, int], digits: int = 6) -> str:
    out = []
    for label, w in windows.items():
        ok = full("CanUseFiveLevelBook", w)
        same = f"min(x) OVER {frame(w)} = max(x) OVER {frame(w)}"
        n = f"count(x) OVER {frame(w)}"
        under = f"({n}) * var_pop(x) OVER {frame(w)} * ({n})"
        out += [r6(f"CASE WHEN {ok} AND {n} >= 2 AND NOT {same} AND {under} > 1e-12 THEN regr_slope(y, x) OVER {frame(w)} END", f"rsrs_{label}", digits), f"{ok} AND {limits(w)} AS rsrs_{label}_has_limit"]
    return ", ".join(out)


SQL["factor_rsrs"] = f"WITH {BASE}, {XY} SELECT security_id, date, sample_time, {slopes({f'{w}t': w for w in T_WINDOWS})} FROM xy"

SQL["factor_summary"] = f"""WITH f AS ({mean_factor('bap', BAP)})
SELECT date, security_id, count(*) AS Rows, {', '.join(f'count(bap_{w}t) AS nnz_bap_{w}t' for w in T_WINDOWS)} FROM f GROUP BY 1, 2"""
_chain = ", ".join(f"b{k} AS ({mean_factor(n, raw)})" for k, (n, raw) in enumerate((("bap", BAP), ("oir", OIR), ("ofd", OFD))))
SQL["factor_chain"] = f"""WITH {_chain}
SELECT security_id, {', '.join(f'count({n}_4t) AS nnz_{n}' for n in ('bap', 'oir', 'ofd'))}, {', '.join(f'count(*) FILTER ({n}_4t_has_limit) AS limits_{n}' for n in ('bap', 'oir', 'ofd'))}
FROM b0 JOIN b1 USING (security_id, date, sample_time) JOIN b2 USING (security_id, date, sample_time) GROUP BY 1"""

ITEMS = """
numbered AS (
  SELECT 'all' AS date, l_suppkey AS security_id, CAST(row_number() OVER o - 1 AS INT) AS tick_idx, l_extendedprice / l_quantity AS p,
         l_quantity > 2 AS CanUsePrice, l_quantity > 2 AND l_partkey % 40 <> 0 AS CanUseDoubleSideBook,
         sum(l_quantity) OVER (o ROWS UNBOUNDED PRECEDING) AS CumVolume
  FROM lineitem WINDOW o AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)
), base AS (SELECT *, CASE WHEN CanUsePrice THEN p END AS Price FROM numbered)"""
SQL["factor_mom_items"] = f"WITH {ITEMS} SELECT security_id, tick_idx, {momentum({'20t': 20, '120t': 120})} FROM base"



def amplitudes(base: str, windows: dict[str, int]) -> str:
    lists = []
    for label, w in windows.items():
        ok = full("CanUsePrice", w)
        cells = f"list({{'level': level, 'at': tick_idx, 'amp': amp}}) OVER (PARTITION BY security_id, tick_idx % 10 ORDER BY tick_idx ROWS BETWEEN {w // 10 - 1} PRECEDING AND CURRENT ROW)"
        lists.append((label, w, max(1, w // 50), ok, cells))
    mean = lambda cells: f"list_avg(list_transform({cells}, lambda x: x.amp))"
    return f"""WITH {base}, tens AS (
  SELECT *, avg(Price) OVER {frame(10)} AS level, max(Price) OVER {frame(10)} / min(Price) OVER {frame(10)} - 1 AS amp FROM base
), held AS (SELECT *, {', '.join(f"CASE WHEN {ok} THEN list_sort({cells}) END AS c{w}, {ok} AND {limits(w)} AS h{w}" for _, w, _, ok, cells in lists)} FROM tens)
SELECT security_id, tick_idx, {', '.join(
        r6(f"CASE WHEN len(list_filter(c{w}, lambda x: x.level IS NOT NULL)) = {w // 10} THEN {mean(f'list_slice(c{w}, -{top}, -1)')} - {mean(f'list_slice(c{w}, 1, {top})')} END", f"amp_slice_{label}")
        + f", h{w} AS amp_slice_{label}_has_limit" for label, w, top, *_ in lists)} FROM held"""


SQL["factor_amp_slice"] = amplitudes(ITEMS, {"60t": 60, "120t": 120, "300t": 300})


def _rigid(w: int) -> str:
    return f"""
near{w} AS (
  SELECT b.security_id, b.tick_idx, count(*) AS n, sum(x) AS x1, sum(x * x) AS x2, sum(x * x * x) AS x3, sum(x * x * x * x) AS x4,
         sum(z) AS y0, sum(x * z) AS y1, sum(x * x * z) AS y2, sum(z * z) AS zz
  FROM base b JOIN (SELECT *, Price - first_value(Price) OVER (PARTITION BY security_id ORDER BY Price IS NULL, tick_idx) AS z FROM base) q
    ON b.security_id = q.security_id AND q.tick_idx BETWEEN b.tick_idx - {w - 1} AND b.tick_idx AND q.Price IS NOT NULL,
  LATERAL (SELECT CAST(q.tick_idx - b.tick_idx + {w - 1} AS DOUBLE) AS x)
  WHERE b.tick_idx >= {w - 1} GROUP BY 1, 2
), solved{w} AS (
  SELECT *, n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x2 * x3) + x2 * (x1 * x3 - x2 * x2) AS det,
    y0 * (x2 * x4 - x3 * x3) - y1 * (x1 * x4 - x2 * x3) + y2 * (x1 * x3 - x2 * x2) AS da,
    n * (y1 * x4 - y2 * x3) - y0 * (x1 * x4 - x2 * x3) + x2 * (x1 * y2 - x2 * y1) AS db,
    n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - x2 * y1) + y0 * (x1 * x3 - x2 * x2) AS dc FROM near{w}
), rigid{w} AS (
  SELECT security_id, tick_idx, CASE WHEN n >= 3 AND det > 1e-20 AND zz - y0 * y0 / n >= 1e-12 THEN
    db / det * (1 - (zz - da / det * y0 - db / det * y1 - dc / det * y2) / (zz - y0 * y0 / n)) * ln(1 / (abs(dc / det) + 1e-8)) END AS v FROM solved{w}
)"""


def rigidities(base: str, windows: dict[str, int], digits: int) -> str:
    gates = ", ".join(f"{full('CanUsePrice', w)} AS ok{w}, {limits(w)} AS h{w}" for w in windows.values())
    out = ", ".join(r6(f"CASE WHEN ok{w} THEN rigid{w}.v END", f"rigidity_{label}", digits) + f", ok{w} AND h{w} AS rigidity_{label}_has_limit" for label, w in windows.items())
    joins = " ".join(f"LEFT JOIN rigid{w} ON g.security_id = rigid{w}.security_id AND g.tick_idx = rigid{w}.tick_idx" for w in windows.values())
    return f"WITH {base}, gates AS (SELECT *, {gates} FROM base), {', '.join(_rigid(w) for w in windows.values())} SELECT g.security_id, g.tick_idx, {out} FROM gates g {joins}"


SQL["factor_rigidity"] = rigidities(ITEMS, {"20t": 20, "60t": 60}, 6)

_change = lambda c, w, more="": f"CASE WHEN CanUsePrice AND lag(CanUsePrice, {w}) OVER ({DAY}){more} THEN {c} / lag({c}, {w}) OVER ({DAY}) - 1 END"


def skews(base: str, windows: dict[str, int], lag: int, digits: int = 6) -> str:
    out = []
    for label, w in windows.items():
        ok, every = full("CanUsePrice", w + lag), f"count(r) OVER {frame(w)} = {w}"
        v = f"CASE WHEN {ok} AND {every} THEN CASE WHEN min(r) OVER {frame(w)} = max(r) OVER {frame(w)} THEN 0.0 WHEN var_samp(r) OVER {frame(w)} > 1e-14 THEN -(skewness(r) OVER {frame(w)}) END END"
        out += [r6(v, f"neg_skew_{label}", digits), f"{ok} AND {limits(w + lag)} AS neg_skew_{label}_has_limit"]
    return f"WITH {base}, changes AS (SELECT *, {_change('Price', lag)} AS r FROM base) SELECT security_id, tick_idx, {', '.join(out)} FROM changes"


SQL["factor_neg_skew"] = skews(ITEMS, {"40t": 40, "100t": 100}, 1)


def price_volume(base: str, windows: dict[str, int], digits: int = 6) -> str:
    one, two, three = [], [], []
    for label, w in windows.items():
        f = frame(2 * w)
        one += [f"{_change('Price', w, f' AND lag(Price, {w}) OVER ({DAY}) > 1e-12')} AS p{w}", f"{_change('CumVolume', w, f' AND lag(CumVolume, {w}) OVER ({DAY}) > 1e-12')} AS v{w}"]
        z = lambda c: f"CASE WHEN count({c}{w}) OVER {f} = {2 * w} AND min({c}{w}) OVER {f} < max({c}{w}) OVER {f} THEN ({c}{w} - avg({c}{w}) OVER {f}) / stddev_pop({c}{w}) OVER {f} END"  # noqa: E731, B023
        two.append(f"CASE WHEN CanUsePrice THEN ({z('p')}) * sign({z('v')}) END AS raw{w}")
        ok = full("CanUsePrice", 4 * w)
        three += [r6(f"CASE WHEN {ok} THEN avg(raw{w}) OVER {frame(w)} END", f"pv_corr_{label}", digits), f"{ok} AND {limits(4 * w)} AS pv_corr_{label}_has_limit"]
    return f"WITH {base}, changes AS (SELECT *, {', '.join(one)} FROM base), raws AS (SELECT *, {', '.join(two)} FROM changes) SELECT security_id, tick_idx, {', '.join(three)} FROM raws"


SQL["factor_pv_corr"] = price_volume(ITEMS, {"10t": 10, "20t": 20})

#: Windows as shipped, over ten long rows of ticks.
_long_book = ", ".join(
    f"p + CAST({0.01 * i!r} AS DOUBLE) + (l_partkey % {i + 3}) * CAST(0.001 AS DOUBLE) AS a{i}, p - CAST({0.01 * i!r} AS DOUBLE) - (l_orderkey % {i + 2}) * CAST(0.001 AS DOUBLE) AS b{i}, "
    f"CAST(1 + (l_orderkey * 11 + {i * 17}) % 50 AS DOUBLE) AS av{i}, CAST(1 + (l_partkey * 7 + {i * 13}) % 50 AS DOUBLE) AS bv{i}"
    for i in range(1, 6)
)
LONG = f"""
priced AS (SELECT *, l_suppkey % 10 AS security_id, round(l_extendedprice / l_quantity + 1e-10, 6) + 0.0 AS p FROM lineitem),
numbered AS (
  SELECT *, CAST(row_number() OVER o - 1 AS INT) AS tick_idx, sum(l_quantity) OVER (o ROWS UNBOUNDED PRECEDING) AS CumVolume
  FROM priced WINDOW o AS (PARTITION BY security_id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice)
), usable AS (SELECT *, NOT (tick_idx % 2500 < 40 AND l_partkey % 3 <> 0) AS CanUsePrice FROM numbered),
base AS (
  SELECT 'all' AS date, security_id, tick_idx, CumVolume, CanUsePrice, CanUsePrice AND l_partkey % 40 <> 0 AS CanUseDoubleSideBook,
         CanUsePrice AND l_partkey % 40 <> 0 AND l_orderkey % 30 <> 0 AS CanUseFiveLevelBook, CASE WHEN CanUsePrice THEN p END AS Price, {_long_book} FROM usable
)"""
MINUTES = lambda *values: {f"{v}m": 20 * v for v in values}
_raws = lambda raw: f"WITH {LONG}, raws AS (SELECT *, {raw} AS raw FROM base) SELECT security_id, tick_idx, "
SQL["factor_bap_shipped"] = f"{_raws(BAP)}{means('bap', MINUTES(15, 30, 45, 60, 75))} FROM raws"
SQL["factor_oir_shipped"] = f"{_raws(OIR)}{means('oir', MINUTES(15, 30, 45, 60, 75))} FROM raws"
SQL["factor_ofd_shipped"] = f"{_raws(OFD)}{means('ofd', MINUTES(15, 30, 45, 60, 75))} FROM raws"
SQL["factor_mom_shipped"] = f"WITH {LONG} SELECT security_id, tick_idx, {momentum(MINUTES(5, 10, 20, 30, 45, 60, 90))} FROM base"
_pairs_shipped = [(25, 50), (50, 100), (100, 200), (150, 300), (200, 400), (300, 600), (400, 800), (500, 1000), (600, 1200)]
SQL["factor_acc_mom_shipped"] = f"WITH {LONG} SELECT security_id, tick_idx, {acceleration(_pairs_shipped)} FROM base"
SQL["factor_rsrs_shipped"] = f"WITH {LONG}, {XY} SELECT security_id, tick_idx, {slopes(MINUTES(30, 45, 60, 75, 105))} FROM xy"
SQL["factor_neg_skew_shipped"] = skews(LONG, MINUTES(15, 30, 45, 60), 20)
SQL["factor_pv_corr_shipped"] = price_volume(LONG, {"100t": 100, "200t": 200, "300t": 300})
SQL["factor_amp_slice_shipped"] = amplitudes(LONG, {"300t": 300, "900t": 900, "1500t": 1500})
SQL["factor_rigidity_shipped"] = rigidities(LONG, MINUTES(10, 105), 6)

RAW = """
lines AS (
  SELECT strftime(ts, '%Y%m%d') AS day, lpad(CAST(user_id AS VARCHAR), 6, '0') AS security_id, event_id, ts, user_id % 2 = 1 AS sh,
         unnest(CASE WHEN event_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS again, CAST(trunc(value * 100) AS BIGINT) AS cents FROM events
), raw AS (
  SELECT *, row_number() OVER (PARTITION BY day, security_id ORDER BY ts, event_id, again) AS file_line,
         CASE WHEN event_id % 13 = 0 THEN 'nan' WHEN event_id % 17 = 0 THEN '24:00:00' ELSE strftime(ts, '%H:%M:%S.%f') END AS UpdateTime,
         CASE WHEN again = 0 THEN CAST(cents AS DOUBLE) END AS LastPrice, CAST(event_id % 1000 AS DOUBLE) AS volume, CASE WHEN sh THEN 'TRADE' ELSE 'T0' END AS status,
         CASE WHEN sh THEN 'SH' ELSE 'SZ' END AS market, CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN ts END AS good FROM lines
)"""
SQL["raw_parse"] = f"""WITH {RAW} SELECT day, security_id, file_line, day AS Date, UpdateTime, {r6('LastPrice')}, CAST(NULL AS DOUBLE) AS PreCloPrice, {r6('volume')}, status, market,
  {r6("CAST(CAST(cents AS VARCHAR) || '.5' AS DOUBLE)", 'AskPrice1')}, CASE WHEN sh THEN CAST(70 AS DOUBLE) END AS BidVolume5 FROM raw"""
SQL["raw_times"] = f"WITH {RAW} SELECT day, security_id, file_line, strftime(good, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM raw"
SQL["raw_days"] = f"WITH {RAW} SELECT DISTINCT day || ' ' || market AS date FROM raw"
SQL["raw_sampled"] = f"""WITH {RAW}, kept AS (
  SELECT * FROM raw WHERE good IS NOT NULL QUALIFY row_number() OVER (PARTITION BY day, security_id, good ORDER BY file_line DESC) = 1
), days AS (SELECT DISTINCT day, security_id, market FROM kept),
times AS (SELECT unnest(generate_series(0, 7)) AS tick_idx),
grid AS (SELECT day, security_id, market, CAST(tick_idx AS INT) AS tick_idx, strptime(day, '%Y%m%d') + to_minutes(CASE WHEN tick_idx < 4 THEN 570 + 30 * tick_idx ELSE 780 + 30 * (tick_idx - 4) END) AS slot FROM days, times)
SELECT strftime(slot, '%Y-%m-%d') AS date, strftime(slot, '%H:%M:%S') AS sample_time, g.day, g.security_id, tick_idx, UpdateTime, {r6('LastPrice')}, {r6('volume')}, status, g.market,
  {r6("date_diff('microsecond', good, slot) / 1e6", 'gap_sec')}
FROM grid g ASOF LEFT JOIN kept k ON g.day = k.day AND g.security_id = k.security_id AND g.slot >= k.good"""

BROKEN = """
cells AS (
  SELECT strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y-%m-%d') AS date, lpad(CAST(user_id AS VARCHAR), 6, '0') AS security_id, ts, event_id, event_type = 'signup' AS halted,
         CASE WHEN user_id % 2 = 1 THEN 'SH' ELSE 'SZ' END AS market, CAST(trunc(value * 100) AS BIGINT) AS cents, (day(ts) + user_id) % 9 AS kind,
         CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN 0 ELSE 1 + (event_id * 11 + 17) % 50 END AS av1, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 0 ELSE 1 + (event_id * 7 + 13) % 50 END AS bv1
  FROM events
), files AS (SELECT day, date, security_id, market, kind, count(DISTINCT ts) AS times FROM cells GROUP BY ALL),
kept AS (SELECT * FROM cells WHERE kind IN (3, 5, 6, 7, 8) QUALIFY row_number() OVER (PARTITION BY day, security_id, ts ORDER BY event_id DESC) = 1),
slots AS (SELECT f.*, CAST(k AS INT) AS tick_idx, strptime(day, '%Y%m%d') + to_minutes(CASE WHEN k < 4 THEN 570 + 30 * k ELSE 780 + 30 * (k - 4) END) AS slot FROM files f, generate_series(0, 7) t(k) WHERE kind IN (3, 5, 6, 7, 8)),
sampled AS (
  SELECT s.day, s.date, s.security_id, s.market, s.kind, s.tick_idx, strftime(slot, '%H:%M:%S') AS sample_time, k.cents, k.halted, k.av1, k.bv1, date_diff('microsecond', k.ts, slot) / 1e6 AS gap
  FROM slots s ASOF LEFT JOIN kept k ON s.day = k.day AND s.security_id = k.security_id AND slot >= k.ts
), seen AS (SELECT date, security_id, count(*) AS n, max(gap) AS top, avg(gap) AS mean, avg(CASE WHEN gap > 36000 THEN 1.0 ELSE 0.0 END) AS share FROM sampled GROUP BY ALL),
report AS (
  SELECT f.date, f.day, f.security_id, f.market, f.kind, CASE WHEN kind IN (1, 2) THEN NULL WHEN kind IN (0, 4) THEN 0 ELSE times END AS RawRows, CASE WHEN kind IN (1, 2) THEN NULL ELSE coalesce(n, 0) END AS SampleRows,
         round_even(top, 1) AS MaxGapSec, round_even(mean, 1) AS MeanGapSec, round_even(share, 4) AS PctGapGt60,
         CASE kind WHEN 0 THEN 'NO_RAW_DATA' WHEN 1 THEN 'FAIL: empty file' WHEN 2 THEN 'FAIL: no column UpdateTime' WHEN 4 THEN 'NO_VALID_TIME'
                   ELSE CASE WHEN top <= 36000 THEN 'OK' ELSE 'LARGE_GAP' END END AS Status
  FROM files f LEFT JOIN seen USING (date, security_id)
), marked AS (
  SELECT *, coalesce(NOT halted, false) AS trade, coalesce(bv1 > 0 AND cents - 1 > 0, false) AS has_bid, coalesce(av1 > 0 AND cents + 1 > 0, false) AS has_ask FROM sampled
), based AS (
  SELECT *, CASE WHEN trade AND has_bid AND has_ask THEN 'NORMAL_WMID' WHEN trade AND has_ask AND NOT has_bid THEN 'LIMIT_DOWN_ONE_SIDED' WHEN trade AND has_bid AND NOT has_ask THEN 'LIMIT_UP_ONE_SIDED' ELSE 'INVALID' END AS PriceType
  FROM marked WHERE kind > 5
), base AS (
  SELECT *, CASE PriceType WHEN 'NORMAL_WMID' THEN (CAST(cents - 1 AS DOUBLE) * av1 + CAST(cents + 1 AS DOUBLE) * bv1) / (av1 + bv1) WHEN 'LIMIT_DOWN_ONE_SIDED' THEN cents + 1 WHEN 'LIMIT_UP_ONE_SIDED' THEN cents - 1 END AS Price FROM based
), flags AS (
  SELECT *, Price IS NOT NULL AS CanUsePrice, trade AND has_bid AND has_ask AS CanUseDoubleSideBook FROM base
)"""
SQL["raw_report"] = f"WITH {BROKEN} SELECT date, security_id, RawRows, SampleRows, {r6s('MaxGapSec', 'MeanGapSec', 'PctGapGt60')}, Status FROM report"
SQL["raw_base"] = f"WITH {BROKEN} SELECT date, security_id, sample_time, market, PriceType, {r6('Price')}, CanUsePrice, CanUseDoubleSideBook, CanUseDoubleSideBook AS CanUseFiveLevelBook FROM flags"
SQL["raw_base_report"] = f"""WITH {BROKEN} SELECT r.date, r.security_id, CASE WHEN kind = 3 THEN 'FAIL: no status column' WHEN kind = 5 THEN 'FAIL: no column AskPrice1' ELSE 'OK' END AS Status, Rows,
  NormalWmidTicks, LimitDownTicks, LimitUpTicks, CanUsePriceTicks, CanUseDoubleTicks, CanUseDoubleTicks AS CanUseFiveTicks
FROM report r LEFT JOIN (SELECT date, security_id, count(*) AS Rows, count(*) FILTER (PriceType = 'NORMAL_WMID') AS NormalWmidTicks, count(*) FILTER (PriceType = 'LIMIT_DOWN_ONE_SIDED') AS LimitDownTicks,
  count(*) FILTER (PriceType = 'LIMIT_UP_ONE_SIDED') AS LimitUpTicks, count(*) FILTER (CanUsePrice) AS CanUsePriceTicks, count(*) FILTER (CanUseDoubleSideBook) AS CanUseDoubleTicks FROM flags GROUP BY ALL) s USING (date, security_id)
WHERE r.kind IN (3, 5, 6, 7, 8)"""
SQL["raw_screen_report"] = f"""WITH {BROKEN}, fates AS (SELECT *, (CAST(substr(day, 7, 2) AS INT) + 2 * CAST(security_id AS INT)) % 11 AS fate FROM report WHERE kind IN (3, 5, 6, 7, 8)),
quiet AS (SELECT date, security_id, bool_and(coalesce(halted, true)) AS still FROM sampled GROUP BY ALL)
SELECT date, security_id, day, CAST(CASE fate WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 8 END AS BIGINT) AS rows,
  CASE fate WHEN 0 THEN 'EMPTY_FILE' WHEN 1 THEN 'ERROR: ticks missing or repeated' ELSE CASE WHEN still AND kind <> 3 THEN 'ALL_DAY_SUSPEND' END END AS drop_reason FROM fates JOIN quiet USING (date, security_id)"""
SQL["table_rerun"] = f"""WITH days AS (SELECT strftime(ts, '%Y-%m-%d') AS date, event_id, user_id, value, strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-08' AND '2024-01-22' AS again, day(ts) % 5 AS k FROM events)
SELECT date, event_id, CASE WHEN NOT again THEN user_id END AS user_id, {r6('value')} FROM days WHERE NOT again OR (value > 20 AND k <> 0)"""
SQL["table_without_rows"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1"
SQL["override_list"] = """SELECT '202401' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS day, CAST(n_nationkey AS VARCHAR) AS security, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS reason
FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 AND n_nationkey % 11 <> 0"""
SQL["factor_metadata"] = """SELECT CAST(p_partkey AS VARCHAR) AS factor_name, p_name AS full_name, p_brand AS category, 'a "' || p_name || '",' || chr(10) || 'of ' || p_type AS description, '-' AS notes
FROM part WHERE regexp_matches(p_brand, '(?i)brand#1.*|steel') OR regexp_matches(p_name || ' ' || p_type || ' ' || CAST(p_partkey AS VARCHAR), '(?i)brand#1.*|steel')"""


# ---- evaluation


def pearson(f: str, r: str) -> str:
    spread = f"sqrt(regr_sxx({r}, {f})) * sqrt(regr_syy({r}, {f}))"
    return f"CASE WHEN {spread} > 1e-12 THEN covar_pop({r}, {f}) * regr_count({r}, {f}) / ({spread}) END"


PANEL = """
monthly AS (
  SELECT strftime(l_shipdate, '%Y') AS date, strftime(l_shipdate, '%m') AS sample_time, l_suppkey AS security_id,
         round(avg(l_extendedprice / l_quantity) + 1e-10, 6) AS price, round(avg(l_discount) + 1e-10, 6) AS alpha_1m,
         round(sum(l_quantity) + 1e-10, 6) AS alpha_2m, CASE WHEN count(*) % 9 <> 1 THEN round(avg(l_tax) + 1e-10, 6) END AS alpha_3m, count(*) AS items
  FROM lineitem GROUP BY 1, 2, 3
), panel AS (
  SELECT *, lead(price, 1) OVER m / price - 1 AS ret_1, lead(price, 2) OVER m / price - 1 AS ret_2,
         items % 5 = 0 AS alpha_1m_has_limit, items % 6 = 0 AS alpha_2m_has_limit, items % 7 = 0 AS alpha_3m_has_limit
  FROM monthly WINDOW m AS (PARTITION BY security_id ORDER BY date, sample_time)
)"""
_rank = lambda c: f"CASE WHEN {c} IS NOT NULL THEN row_number() OVER (PARTITION BY date, sample_time ORDER BY {c} NULLS LAST, security_id) END AS rank_{c}"
_parts = [
    f"SELECT date, sample_time, '{r}' AS ret, '{f}' AS factor_col, {pearson(f, r)} AS ic, {pearson(f'rank_{f}', f'rank_{r}')} AS rankic FROM ranked GROUP BY 1, 2"
    for f in FACTORS for r in RETURNS
]
IC = PANEL + f", ranked AS (SELECT *, {', '.join(_rank(c) for c in FACTORS + RETURNS)} FROM panel), ic AS ({' UNION ALL '.join(_parts)})"
SESSIONS = """(SELECT 'all' AS session, '00' AS low, '99' AS high UNION ALL SELECT 'am', '00', '06' UNION ALL SELECT 'pm', '07', '99')"""
DAILY = IC + f""", split AS (SELECT ic.*, session FROM ic JOIN {SESSIONS} ON sample_time BETWEEN low AND high),
daily AS (SELECT date, ret, session, factor_col, avg(ic) AS ic, avg(rankic) AS rankic FROM split GROUP BY ALL)"""


def _stats(spread: str, extra: int) -> str:
    return DAILY + f""", moments AS (
  SELECT ret, session, factor_col, avg(ic) AS ic_mean, avg(rankic) AS rankic_mean, CASE WHEN count(ic) > 1 THEN {spread}(ic) END AS ic_std,
         CASE WHEN count(rankic) > 1 THEN {spread}(rankic) END AS rankic_std, count(*) + {extra} AS n_days FROM daily GROUP BY ALL
), stats AS (
  SELECT *, CASE WHEN ic_std > 1e-12 THEN ic_mean / ic_std END AS icir, CASE WHEN rankic_std > 1e-12 THEN rankic_mean / rankic_std END AS rankic_ir,
         'alpha' AS factor_name, CAST(substr(factor_col, 7, 1) AS INT) AS factor_window FROM moments
)"""


STATS = _stats("stddev_samp", 0)
STAT_COLUMNS = f"ret, session, factor_col, {r6s('ic_mean', 'rankic_mean', 'ic_std', 'rankic_std')}, n_days, {r6s('icir', 'rankic_ir')}, factor_name, factor_window"
SQL["pressure_ic"] = f"""WITH {BASE}, raws AS (SELECT *, {BAP} AS raw, {_ret(1)} AS ret FROM base),
f AS (SELECT *, CASE WHEN {full('raw IS NOT NULL', 4)} THEN avg(raw) OVER {frame(4)} END AS bap FROM raws),
ics AS (SELECT date, sample_time, {pearson('bap', 'ret')} AS ic FROM f GROUP BY 1, 2) SELECT date, {r6('avg(ic)', 'ic')}, count(ic) AS n FROM ics GROUP BY 1"""
SQL["cs_ic"] = f"WITH {IC} SELECT date, sample_time, ret, factor_col, {r6s('ic', 'rankic')} FROM ic"
SQL["cs_ic_sessions"] = f"WITH {DAILY} SELECT date, sample_time, ret, factor_col, {r6s('ic', 'rankic')}, session FROM split"
SQL["cs_daily_trend"] = f"WITH {DAILY} SELECT date, ret, session, factor_col, {r6s('ic', 'rankic')} FROM daily"
SQL["cs_ic_stats"] = f"WITH {STATS} SELECT {STAT_COLUMNS} FROM stats"
SQL["factor_stats"] = f"""WITH {STATS} SELECT 'alpha' AS factor_name, ret, session, factor_col, {r6('ic_mean')}, n_days FROM stats WHERE factor_col = 'alpha_1m'
UNION ALL SELECT 'gamma', ret, session, factor_col, {r6('ic_mean')}, n_days FROM stats WHERE factor_col = 'alpha_3m'"""
SQL["returns_source"] = f"""WITH {PANEL}, early AS (SELECT * FROM panel WHERE date < '1996'), late AS (SELECT * FROM panel WHERE date >= '1994')
SELECT coalesce(e.date, l.date) AS date, coalesce(e.sample_time, l.sample_time) AS sample_time, coalesce(e.security_id, l.security_id) AS security_id, {r6('coalesce(e.ret_1, l.ret_1 + 1)', 'ret_1')}, {r6('e.alpha_1m', 'alpha_1m')}, {r6('l.alpha_2m', 'alpha_2m')}
FROM early e FULL JOIN late l ON e.date = l.date AND e.sample_time = l.sample_time AND e.security_id = l.security_id"""
SQL["cs_ic_stats_added"] = SQL["cs_ic_stats"]
SQL["cs_ic_stats_compat"] = f"WITH {_stats('stddev_pop', 1)} SELECT {STAT_COLUMNS} FROM stats"
_pairs = " UNION ALL ".join(
    f"SELECT date, security_id, sample_time, '{r}' AS ret, '{f}' AS factor_col, {f} AS f, {r} AS r FROM panel WHERE {f} IS NOT NULL AND {r} IS NOT NULL AND NOT {f}_has_limit" for f in FACTORS for r in RETURNS
)
TS = PANEL + f""", pairs AS ({_pairs}), long AS (SELECT pairs.*, session FROM pairs JOIN {SESSIONS} ON sample_time BETWEEN low AND high),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date, security_id, session, ret, factor_col ORDER BY f, sample_time) AS rf,
  row_number() OVER (PARTITION BY date, security_id, session, ret, factor_col ORDER BY r, sample_time) AS rr FROM long),
ts AS (SELECT date, security_id, session, ret, factor_col, CASE WHEN count(*) >= 2 THEN {pearson('f', 'r')} END AS ts_ic, CASE WHEN count(*) >= 2 THEN {pearson('rf', 'rr')} END AS ts_rankic FROM ranked GROUP BY ALL)"""
SQL["ts_ic"] = f"WITH {TS} SELECT date, security_id, session, ret, factor_col, {r6s('ts_ic', 'ts_rankic')} FROM ts"
SQL["ts_ic_stats"] = f"""WITH {TS}, each AS (
  SELECT ret, session, factor_col, security_id, avg(ts_ic) AS m, avg(ts_rankic) AS rm,
    CASE WHEN count(ts_ic) >= 2 AND stddev_pop(ts_ic) > 1e-12 THEN avg(ts_ic) / stddev_pop(ts_ic) END AS ir,
    CASE WHEN count(ts_rankic) >= 2 AND stddev_pop(ts_rankic) > 1e-12 THEN avg(ts_rankic) / stddev_pop(ts_rankic) END AS rir FROM ts GROUP BY ALL
), days AS (SELECT ret, session, factor_col, count(DISTINCT date) AS n_days FROM ts GROUP BY ALL)
SELECT ret, session, factor_col, {r6('avg(m)', 'ic_mean')}, {r6('avg(rm)', 'rankic_mean')}, {r6('avg(ir)', 'icir')}, {r6('avg(rir)', 'rankic_ir')}, any_value(n_days) AS n_days, count(*) AS n_stocks
FROM each JOIN days USING (ret, session, factor_col) GROUP BY ret, session, factor_col"""

SQL["ts_ic_stats_added"] = SQL["ts_ic_stats"]


# ---- quantiles


def _bucket(f: str, q: int) -> str:
    place = f"(row_number() OVER (PARTITION BY date, sample_time ORDER BY {f} NULLS LAST, security_id) - 1) * {q} // count({f}) OVER (PARTITION BY date, sample_time) + 1"
    return f"CASE WHEN {f} IS NOT NULL AND count({f}) OVER (PARTITION BY date, sample_time) >= {q} THEN CAST({place} AS INT) END"


G5, G10 = [f"g{k}" for k in range(1, 6)], [f"g{k}" for k in range(1, 11)]
_means = lambda q, f: ", ".join(f"avg(ret_1) FILTER (bucket_{f} = {k}) AS g{k}" for k in range(1, q + 1))
BUCKETS = PANEL + f""", bucketed AS (SELECT *, {', '.join(f"{_bucket(f, 5)} AS bucket_{f}" for f in FACTORS)} FROM panel),
buckets AS ({' UNION ALL '.join(f"SELECT date, sample_time, '{f}' AS factor_col, {_means(5, f)}, count({f}) AS n_valid FROM bucketed GROUP BY 1, 2" for f in FACTORS)})"""


def _curves(gs: list[str], counted: str) -> str:
    run = ", ".join(f"CASE WHEN {g} IS NOT NULL THEN sum({g}) OVER (PARTITION BY factor_col, date ORDER BY sample_time ROWS UNBOUNDED PRECEDING) END AS {g}" for g in gs)
    days = ", ".join(f"CASE WHEN {g} IS NOT NULL THEN sum({g}) OVER (PARTITION BY factor_col ORDER BY date ROWS UNBOUNDED PRECEDING) END AS {g}" for g in gs)
    before = ", ".join(f"coalesce(last_value({g} IGNORE NULLS) OVER (PARTITION BY factor_col ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b{g}" for g in gs)
    on_top = ", ".join(f"t.{g} + b{g} AS {g}" for g in gs)
    return f""",
cum0 AS (SELECT factor_col, date, sample_time, {run} FROM buckets), cum AS (SELECT *, {gs[-1]} - g1 AS long_short FROM cum0),
day0 AS (SELECT factor_col, date, {', '.join(f'sum({g}) AS {g}' for g in gs)}, count({counted}) AS n_ticks FROM buckets GROUP BY 1, 2),
day1 AS (SELECT factor_col, date, {days}, CAST(sum(n_ticks) OVER (PARTITION BY factor_col ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_ticks FROM day0), days AS (SELECT *, {gs[-1]} - g1 AS long_short FROM day1),
earlier AS (SELECT factor_col, date, {before} FROM days),
stitched AS (SELECT *, {gs[-1]} - g1 AS long_short FROM (SELECT t.factor_col, t.date, t.sample_time, {on_top} FROM cum t JOIN earlier e ON t.factor_col = e.factor_col AND t.date = e.date))"""


CURVES = BUCKETS + _curves(G5, "g5")
SQL["quantile_buckets"] = f"WITH {BUCKETS} SELECT date, sample_time, security_id, {', '.join(f'bucket_{f}' for f in FACTORS)} FROM bucketed"
SQL["quantile_returns"] = f"WITH {BUCKETS} SELECT date, sample_time, factor_col, {r6s(*G5)}, n_valid FROM buckets"
DAYS5 = BUCKETS + f", means AS (SELECT factor_col, date, {', '.join(f'avg({g}) AS {g}' for g in G5)} FROM buckets GROUP BY 1, 2)"
SQL["quantile_daily"] = f"WITH {DAYS5} SELECT factor_col, date, {r6s(*G5)} FROM means"
SQL["quantile_summary"] = f"WITH {DAYS5} SELECT factor_col, {', '.join(r6(f'avg({g})', g) for g in G5)} FROM means GROUP BY 1"
SQL["quantile_cum_tick"] = f"WITH {CURVES} SELECT factor_col, date, sample_time, {r6s(*G5, 'long_short')} FROM cum"
SQL["quantile_cum_daily"] = f"WITH {CURVES} SELECT factor_col, date, {r6s(*G5, 'long_short')}, n_ticks FROM days"
SQL["quantile_cum_daily_added"] = SQL["quantile_cum_daily"]
SQL["quantile_stitched"] = f"WITH {CURVES} SELECT factor_col, date, sample_time, {r6s(*G5, 'long_short')} FROM stitched"
SQL["quantile_chart"] = f"""WITH {CURVES} SELECT factor_col, date, sample_time, CAST(row_number() OVER (PARTITION BY factor_col ORDER BY date, sample_time) - 1 AS INT) AS x,
  sample_time = min(sample_time) OVER (PARTITION BY factor_col, date) AS month_start, {r6('long_short')} FROM stitched"""

WEIGHTS = STATS + """, weights AS (SELECT ret, factor_col, ic_mean, ic_mean / sum(abs(ic_mean)) OVER (PARTITION BY ret) AS weight FROM stats WHERE session = 'all' AND abs(ic_mean) >= 0.001)"""
_score = lambda f: f"CASE WHEN {f} IS NOT NULL THEN (row_number() OVER (PARTITION BY date, sample_time ORDER BY {f} NULLS LAST, security_id) - 1) / count({f}) OVER (PARTITION BY date, sample_time) END"
_weighted = " UNION ALL ".join(f"SELECT date, sample_time, security_id, '{f}' AS factor_col, {_score(f)} AS score FROM panel" for f in FACTORS)
SCORED = WEIGHTS + f""", scores AS ({_weighted}), chosen AS (SELECT factor_col, round(weight, 6) AS w FROM weights WHERE ret = 'ret_1'),
blended AS (SELECT date, sample_time, security_id, CASE WHEN sum(abs(w)) > 1e-9 THEN sum(w * score) / sum(abs(w)) END AS c FROM scores JOIN chosen USING (factor_col) WHERE score IS NOT NULL GROUP BY 1, 2, 3),
scored AS (SELECT p.*, round(c + 1e-10, 6) + 0.0 AS composite FROM panel p LEFT JOIN blended b ON p.date = b.date AND p.sample_time = b.sample_time AND p.security_id = b.security_id),
tens AS (SELECT *, {_bucket('composite', 10)} AS bucket_c FROM scored),
buckets AS (SELECT date, sample_time, avg(composite) AS composite_mean, stddev_pop(composite) AS composite_std, count(composite) AS n_valid, {_means(10, 'c')}, 'composite' AS factor_col FROM tens GROUP BY 1, 2)"""
SQL["composite_weights"] = f"WITH {WEIGHTS} SELECT ret, factor_col, {r6s('ic_mean', 'weight')} FROM weights"
SQL["percentile_score"] = f"WITH {PANEL} SELECT date, sample_time, security_id, {', '.join(r6(_score(f), f'score_{f}') for f in FACTORS)} FROM panel"
SQL["composite_score"] = f"WITH {SCORED} SELECT date, sample_time, security_id, composite FROM scored"
SQL["composite_deciles"] = f"WITH {SCORED} SELECT date, sample_time, {r6s('composite_mean', 'composite_std')}, n_valid, {r6s(*G10)}, factor_col FROM buckets"
_days10 = f", means AS (SELECT factor_col, date, {', '.join(f'avg({g}) AS {g}' for g in G10)} FROM buckets GROUP BY 1, 2)"
SQL["composite_daily"] = f"WITH {SCORED}{_days10} SELECT factor_col, date, {r6s(*G10)} FROM means"
SQL["composite_summary"] = f"WITH {SCORED}{_days10} SELECT factor_col, {', '.join(r6(f'avg({g})', g) for g in G10)} FROM means GROUP BY 1"
SQL["composite_cum_tick"] = f"WITH {SCORED}{_curves(G10, 'g1')} SELECT factor_col, date, sample_time, {r6s(*G10, 'long_short')} FROM cum"
SQL["composite_cum_daily"] = f"WITH {SCORED}{_curves(G10, 'g1')} SELECT factor_col, date, {r6s(*G10, 'long_short')}, n_ticks FROM days"


# ---- views

SQL["view_available_dates"] = f"WITH {PANEL} SELECT DISTINCT date FROM panel"
SQL["view_ic_summary"] = f"WITH {STATS} SELECT {STAT_COLUMNS} FROM stats WHERE ret = 'ret_1' AND session = 'am'"
SQL["view_ic_trend"] = f"WITH {DAILY} SELECT date, ret, session, factor_col, {r6s('ic', 'rankic')} FROM daily WHERE factor_col = 'alpha_2m' AND session = 'all' AND ret = 'ret_1'"
SQL["view_quantile_day"] = f"WITH {BUCKETS} SELECT date, sample_time, factor_col, {r6s(*G5)}, n_valid FROM buckets WHERE factor_col = 'alpha_1m' AND date = '1997'"
SQL["view_plot_lines"] = f"""WITH {STATS} SELECT ret, factor_col, factor_window, 'IC ' || session AS line, {r6('ic_mean', 'mean')}, {r6('icir', 'ir')} FROM stats
UNION ALL SELECT ret, factor_col, factor_window, 'RankIC ' || session, {r6('rankic_mean', 'mean')}, {r6('rankic_ir', 'ir')} FROM stats"""
SQL["view_monotonicity"] = f"""WITH {CURVES} SELECT factor_col, {r6('CASE WHEN abs(g2 - g4) >= 1e-12 THEN (g1 - g5) / (g2 - g4) END', 'monotonicity')}
FROM days d WHERE date = (SELECT max(date) FROM days e WHERE e.factor_col = d.factor_col)"""
_names = [*G5, "long_short"]
SQL["view_pnl"] = f"""WITH {CURVES}, totals AS (SELECT factor_col, count(g5) AS total_ticks, max(date) AS date FROM buckets GROUP BY 1)
SELECT d.factor_col, {r6s(*_names)}, total_ticks, {', '.join(r6(f'{c} / nullif(total_ticks, 0)', f'{c}_per_tick') for c in _names)} FROM days d JOIN totals t ON d.factor_col = t.factor_col AND d.date = t.date"""
SQL["view_day_pnl"] = f"""WITH {CURVES}, lasts AS (SELECT *, count(*) OVER (PARTITION BY factor_col, date) AS n, row_number() OVER (PARTITION BY factor_col, date ORDER BY sample_time DESC) AS k FROM cum WHERE g5 IS NOT NULL)
SELECT factor_col, date, {r6s(*_names)}, n, {', '.join(r6(f'{c} / n', f'{c}_per_tick') for c in _names)} FROM lasts WHERE k = 1"""
SQL["view_search"] = "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE " + " OR ".join(f"regexp_matches(coalesce(CAST({c} AS VARCHAR), ''), '(?i)brand#1.*|steel')" for c in ("p_partkey", "p_name", "p_brand", "p_type"))
SQL["view_natural_order"] = "SELECT DISTINCT p_brand, coalesce(TRY_CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT), -1) AS number, coalesce(TRY_CAST(regexp_extract(substr(p_brand, 7), '(\\d+)', 1) AS INT), 0) AS window FROM part"
