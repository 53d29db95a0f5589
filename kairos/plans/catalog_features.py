"""Registered queries: bars and per-instrument window features (A1-A5, B8,
B10, C3, C4, C6, E1-E27, H1)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as E
from ..operators.joins import market_return
from ..registry import register
from . import fixtures as FX
from .silver import core_features, daily_features, silver_table
from .sqltext import BARS, SILVER, W, dbl, rows, with_ctes

S = with_ctes(BARS, SILVER)
BARS_ONLY = with_ctes(BARS)


def _silver(spark, sf):
    return silver_table(spark, sf)


def _bench_chain(b):
    from .silver import benchmark_features, with_bench
    return with_bench(E.with_returns(b), benchmark_features(b))


BUILD = {
    "core": lambda b: core_features(b),
    "rsi": lambda b: E.with_rsi(E.with_returns(b)),
    "macd": lambda b: E.with_macd(b),
    "bollinger": lambda b: E.with_bollinger(b),
    "atr_roc": lambda b: E.with_roc(E.with_atr(b)),
    "zscore": lambda b: E.with_zscore(b),
    "relative": lambda b: E.with_percent_rank(E.with_relative_return(_bench_chain(b)), "relative_return_20d",
                                              "relative_return_percentile", round_digits=10),
    "forward": lambda b: E.with_forward_distribution(E.with_forward_return(E.with_returns(b))),
    "mean_rev": lambda b: E.with_mean_reversion(E.with_returns(b)),
}


def _q(name, cols, floats, ops, build, extra_sql_cols=None):
    """Register a projection of the silver table (Spark side builds only the
    operators the projection needs)."""
    sql_cols = ", ".join(extra_sql_cols or cols)

    @register(name, sql=S + f"SELECT ticker, dt, {sql_cols} FROM silver", floats=floats, ops=ops)
    def q(spark, sf):
        b = FX.bars_table(spark, sf)
        if build == "regime":
            return _regime(b).select("ticker", "dt", *cols)
        return BUILD[build](b).select("ticker", "dt", *cols)
    q.__name__ = name
    return q


def _regime(b):
    from .silver import benchmark_features, with_bench
    df = with_bench(E.with_drawdown(b), benchmark_features(b))
    return df.withColumn("median_drawdown", F.percentile("drawdown_pct", 0.5).over(Window.partitionBy("ticker")))


@register("bars", sql=BARS_ONLY + "SELECT * FROM bars", floats=("open", "high", "low", "close"),
          ops=("A5", "C1"))
def q_bars(spark, sf):
    """Daily OHLCV bars per instrument plus the benchmark."""
    return FX.bars(spark, sf)


_q("returns_drawdown", ["daily_return", "log_return", "running_max", "drawdown_pct", "drawdown_percentile"],
   ["daily_return", "log_return", "running_max", "drawdown_pct", "drawdown_percentile"], ("E1", "E2", "E3"),
   "core")
_q("volatility", ["realized_vol_20d", "realized_vol_60d", "vol_percentile", "volume_percentile"],
   ["realized_vol_20d", "realized_vol_60d", "vol_percentile", "volume_percentile"], ("E3", "E6"), "core")
_q("rsi", ["avg_gain_14", "avg_loss_14", "rsi_14"], ["avg_gain_14", "avg_loss_14", "rsi_14"], ("E8",), "rsi")
_q("macd_sma", ["ema_12", "ema_26", "macd_line", "macd_signal", "macd_histogram"],
   ["ema_12", "ema_26", "macd_line", "macd_signal", "macd_histogram"], ("E9",), "macd")
_q("bollinger", ["bb_mid", "bb_std", "bb_upper", "bb_lower", "bb_pct_b", "bb_width"],
   ["bb_mid", "bb_std", "bb_upper", "bb_lower", "bb_pct_b", "bb_width"], ("E11",), "bollinger")
_q("atr_roc", ["true_range", "atr_14", "roc_5", "roc_20", "roc_60"],
   ["true_range", "atr_14", "roc_5", "roc_20", "roc_60"], ("E12", "E13"), "atr_roc")
_q("zscores", ["zscore_20d", "zscore_60d"], ["zscore_20d", "zscore_60d"], ("E14",), "zscore")
_q("relative_return", ["bench_return", "relative_return", "relative_return_20d", "relative_return_percentile"],
   ["bench_return", "relative_return", "relative_return_20d", "relative_return_percentile"], ("C3", "E16", "E3"),
   "relative")
_q("forward_returns", ["fwd_return_5d", "fwd_return_20d", "fwd_return_60d"],
   ["fwd_return_5d", "fwd_return_20d", "fwd_return_60d"], ("E19",), "forward")
_q("forward_distribution", ["fwd_60d_skew", "fwd_60d_p5", "fwd_60d_p25", "fwd_60d_median", "fwd_60d_p75",
                            "fwd_60d_p95"],
   ["fwd_60d_skew", "fwd_60d_p5", "fwd_60d_p25", "fwd_60d_median", "fwd_60d_p75", "fwd_60d_p95"],
   ("E20", "U1", "U2"), "forward")
_q("mean_reversion", ["rolling_return_20d", "rolling_return_lag1", "mean_reversion_score"],
   ["rolling_return_20d", "rolling_return_lag1", "mean_reversion_score"], ("E21",), "mean_rev")
_q("vol_regime", ["bench_vol_20d", "bench_vol_threshold", "vol_regime", "median_drawdown"],
   ["bench_vol_20d", "bench_vol_threshold", "median_drawdown"], ("E27", "C5", "C6", "D9"), "regime")


@register("vol_term_structure",
          sql=S + "SELECT ticker, dt, realized_vol_20d / NULLIF(realized_vol_60d, 0) AS vol_term_structure FROM silver",
          floats=("vol_term_structure",), ops=("E7",))
def q_vol_term(spark, sf):
    """20-day over 60-day volatility."""
    return E.with_vol_term(_silver(spark, sf)).select("ticker", "dt", "vol_term_structure")


@register("dip_top20", sql=S.rstrip() + """,
latest AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn FROM silver)
SELECT ticker, dt, close, drawdown_pct, drawdown_percentile,
       COALESCE(drawdown_percentile > 0.8, FALSE) AS signal_1
FROM latest WHERE rn = 1
ORDER BY drawdown_percentile DESC, ticker LIMIT 20""",
          floats=("close", "drawdown_pct", "drawdown_percentile"), ops=("E1", "E2", "E3", "F1", "B10", "H1"))
def q_dip_top20(spark, sf):
    """Flagship: each instrument's latest bar with drawdown and dip flag, top 20
    by drawdown percentile."""
    from ..operators.ranking import latest_per_key, top_n
    from ..operators.signals import signal_dip
    df = E.with_drawdown(E.with_returns(FX.bars_table(spark, sf)))
    df = E.with_percent_rank(df, "drawdown_pct", "drawdown_percentile")
    df = latest_per_key(df, "ticker", "dt").select(
        "ticker", "dt", "close", "drawdown_pct", "drawdown_percentile", signal_dip().alias("signal_1"))
    return top_n(df, [F.col("drawdown_percentile").desc(), F.col("ticker").asc()], 20)


# --- variant operators (NB/LOC forms) --------------------------------------------

def _const(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _ema_sql():
    a12, a26, a9 = 2.0 / 13.0, 2.0 / 27.0, 2.0 / 10.0
    return "WITH RECURSIVE " + BARS.strip() + f""",
base AS (SELECT ticker, dt, close, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt) AS rn FROM bars),
e AS (
  SELECT ticker, rn, dt, close AS ema_12, close AS ema_26 FROM base WHERE rn = 1
  UNION ALL
  SELECT b.ticker, b.rn, b.dt, e.ema_12 * {_const(1 - a12)} + b.close * {_const(a12)},
         e.ema_26 * {_const(1 - a26)} + b.close * {_const(a26)}
  FROM e JOIN base b ON b.ticker = e.ticker AND b.rn = e.rn + 1),
m AS (SELECT ticker, rn, dt, ema_12, ema_26, ema_12 - ema_26 AS macd_line FROM e),
s AS (
  SELECT ticker, rn, macd_line AS macd_signal FROM m WHERE rn = 1
  UNION ALL
  SELECT m.ticker, m.rn, s.macd_signal * {_const(1 - a9)} + m.macd_line * {_const(a9)}
  FROM s JOIN m ON m.ticker = s.ticker AND m.rn = s.rn + 1)
SELECT m.ticker, m.dt, m.ema_12, m.ema_26, m.macd_line, s.macd_signal, m.macd_line - s.macd_signal AS macd_histogram
FROM m JOIN s ON m.ticker = s.ticker AND m.rn = s.rn"""


@register("macd_ema", sql=_ema_sql(), floats=("ema_12", "ema_26", "macd_line", "macd_signal", "macd_histogram"),
          digits=5, ops=("E10",))
def q_macd_ema(spark, sf):
    """MACD 12/26/9 with true exponential means (adjust=False)."""
    return E.with_macd(FX.bars_table(spark, sf), kind="ema").select(
        "ticker", "dt", "ema_12", "ema_26", "macd_line", "macd_signal", "macd_histogram")


def _trail_sql(col):
    prev = f"OVER ({W} ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING)"
    return f"""
  CASE WHEN {col} IS NOT NULL AND COUNT({col}) {prev} = COUNT(*) {prev} AND COUNT({col}) {prev} > 0
            AND COUNT({col}) {prev} + 1 >= 60 THEN
    (len(list_filter(LIST({col}) {prev}, lambda e: e IS NOT NULL AND e < {col}))
     + CASE WHEN len(list_filter(LIST({col}) {prev}, lambda e: e IS NOT NULL AND e = {col})) > 0
            THEN (len(list_filter(LIST({col}) {prev}, lambda e: e IS NOT NULL AND e = {col})) + 1) / 2.0
            ELSE 0.0 END) / COUNT({col}) {prev} END"""


@register("trailing_percentile", sql=S + f"""
SELECT ticker, dt, {_trail_sql('realized_vol_20d')} AS vol_pct_trailing,
       {_trail_sql('CAST(volume AS DOUBLE)')} AS volume_pct_trailing
FROM silver""", floats=("vol_pct_trailing", "volume_pct_trailing"), ops=("E5",))
def q_trailing(spark, sf):
    """Percentile of today's value among the previous 251 rows (min 60)."""
    df = E.with_realised_vol(E.with_returns(FX.bars_table(spark, sf)), ns=(20,))
    df = df.withColumn("volume_d", F.col("volume").cast("double"))
    df = E.with_trailing_percentile(df, "realized_vol_20d", "vol_pct_trailing")
    df = E.with_trailing_percentile(df, "volume_d", "volume_pct_trailing")
    return df.select("ticker", "dt", "vol_pct_trailing", "volume_pct_trailing")


@register("autocorr", sql=S.rstrip() + f""",
a AS (SELECT ticker, dt, daily_return, LAG(daily_return) OVER ({W}) AS lag1 FROM silver)
SELECT ticker, dt, CASE WHEN COUNT(daily_return) {rows(60)} = 60 THEN
  COVAR_POP(CASE WHEN lag1 IS NOT NULL THEN daily_return END, CASE WHEN daily_return IS NOT NULL THEN lag1 END) {rows(59)}
  / NULLIF(STDDEV_POP(CASE WHEN lag1 IS NOT NULL THEN daily_return END) {rows(59)}
         * STDDEV_POP(CASE WHEN daily_return IS NOT NULL THEN lag1 END) {rows(59)}, 0) END AS autocorr_lag1
FROM a""", floats=("autocorr_lag1",), ops=("E22",))
def q_autocorr(spark, sf):
    """Rolling lag-1 autocorrelation of daily returns, 60 rows."""
    return E.with_autocorr(E.with_returns(FX.bars_table(spark, sf))).select("ticker", "dt", "autocorr_lag1")


@register("obv", sql=with_ctes(BARS).rstrip() + f""",
l AS (SELECT ticker, dt, close, volume, LAG(close) OVER ({W}) AS pc, ROW_NUMBER() OVER ({W}) AS idx FROM bars),
o AS (
  SELECT ticker, dt, idx, SUM(COALESCE(CAST(SIGN(close - pc) AS DOUBLE) * volume, 0.0))
           OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv_raw FROM l)
SELECT ticker, dt, obv_raw AS obv,
       CASE WHEN COUNT(*) {rows(20)} = 20 THEN COALESCE(REGR_SLOPE(obv_raw, CAST(idx AS DOUBLE)) {rows(20)}, 0.0) END
         AS obv_slope_20d
FROM o""", floats=("obv", "obv_slope_20d"), digits=3, ops=("E23",))
def q_obv(spark, sf):
    """On-balance volume and its 20-row regression slope."""
    return E.with_obv(FX.bars_table(spark, sf)).select("ticker", "dt", "obv", "obv_slope_20d")


@register("stochastic", sql=with_ctes(BARS).rstrip() + f""",
k AS (
  SELECT ticker, dt, CASE WHEN COUNT(low) {rows(14)} >= 14 AND COUNT(high) {rows(14)} >= 14 THEN
    100.0 * (close - MIN(low) {rows(14)}) / NULLIF(MAX(high) {rows(14)} - MIN(low) {rows(14)}, 0) END AS stoch_k
  FROM bars)
SELECT ticker, dt, stoch_k, CASE WHEN COUNT(stoch_k) {rows(3)} >= 3 THEN AVG(stoch_k) {rows(3)} END AS stoch_d
FROM k""", floats=("stoch_k", "stoch_d"), ops=("E24",))
def q_stochastic(spark, sf):
    """Stochastic %K 14 and %D 3."""
    return E.with_stochastic(FX.bars_table(spark, sf)).select("ticker", "dt", "stoch_k", "stoch_d")


@register("mfi", sql=with_ctes(BARS).rstrip() + f""",
t AS (SELECT ticker, dt, volume, (high + low + close) / 3.0 AS tp FROM bars),
f AS (SELECT ticker, dt, tp, LAG(tp) OVER ({W}) AS ptp, tp * volume AS mf FROM t),
g AS (SELECT ticker, dt, CASE WHEN tp > ptp THEN mf ELSE 0.0 END AS pos,
             CASE WHEN tp <= ptp THEN mf ELSE 0.0 END AS neg FROM f)
SELECT ticker, dt, CASE WHEN COUNT(*) {rows(14)} = 14 THEN
  100.0 - 100.0 / (1.0 + SUM(pos) {rows(14)} / NULLIF(SUM(neg) {rows(14)}, 0)) END AS mfi_14
FROM g""", floats=("mfi_14",), ops=("E25",))
def q_mfi(spark, sf):
    """Money flow index, 14 rows."""
    return E.with_mfi(FX.bars_table(spark, sf)).select("ticker", "dt", "mfi_14")


@register("sector_zscore", sql=S + """
SELECT ticker, dt, (roc_20 - AVG(roc_20) OVER (PARTITION BY sector, dt))
       / NULLIF(STDDEV_SAMP(roc_20) OVER (PARTITION BY sector, dt), 0) AS roc_20_sector_z
FROM silver""", floats=("roc_20_sector_z",), ops=("E18",))
def q_sector_z(spark, sf):
    """20-row return z-scored within (sector, date)."""
    df = E.with_roc(FX.bars_table(spark, sf), ns=(20,))
    return E.with_sector_zscore(df, "roc_20").select("ticker", "dt", "roc_20_sector_z")


@register("average_rank", sql=S + """
SELECT ticker, dt, CASE WHEN drawdown_pct IS NOT NULL THEN
  (RANK() OVER (PARTITION BY ticker ORDER BY drawdown_pct ASC NULLS LAST)
   + (COUNT(*) OVER (PARTITION BY ticker, drawdown_pct) - 1) / 2.0)
  / COUNT(drawdown_pct) OVER (PARTITION BY ticker) END AS drawdown_rank_avg
FROM silver""", floats=("drawdown_rank_avg",), ops=("E4",))
def q_average_rank(spark, sf):
    """Average-rank percentile of drawdown within each instrument."""
    df = E.with_drawdown(FX.bars_table(spark, sf))
    return E.with_percent_rank(df, "drawdown_pct", "drawdown_rank_avg", method="average") \
        .select("ticker", "dt", "drawdown_rank_avg")


@register("relative_compound", sql=S.rstrip() + f""",
mr AS (
  SELECT dt AS mdt, CASE WHEN MAX(CASE WHEN ticker = 'MKT' THEN 1 ELSE 0 END) = 1
                         THEN MAX(CASE WHEN ticker = 'MKT' THEN daily_return END)
                         ELSE AVG(CASE WHEN ticker <> 'MKT' THEN daily_return END) END AS mret
  FROM silver GROUP BY dt),
j AS (SELECT s.ticker, s.dt, s.roc_20, mr.mret FROM silver s LEFT JOIN mr ON s.dt = mr.mdt)
SELECT ticker, dt, mret AS bench_return, roc_20 - SUM(mret) {rows(20)} AS relative_return_20d FROM j
""", floats=("bench_return", "relative_return_20d"), ops=("C4", "E17"))
def q_relative_compound(spark, sf):
    """20-row price return minus the summed market return (benchmark, or the
    cross-sectional mean where the benchmark has no bar)."""
    df = market_return(E.with_returns(FX.bars_table(spark, sf)))
    df = E.with_relative_return(df, kind="compound")
    return df.select("ticker", "dt", "bench_return", "relative_return_20d")


@register("hurst", ops=("E26", "U5"))
def q_hurst(spark, sf):
    """Rolling R/S Hurst exponent over the previous 252 returns."""
    return E.with_hurst(E.with_returns(FX.bars_table(spark, sf))).select("ticker", "dt", "hurst_exponent")


@register("xs_rank", sql=S + """
SELECT ticker, dt,
  PERCENT_RANK() OVER (PARTITION BY dt ORDER BY roc_20 ASC NULLS FIRST) AS roc_20_xs_rank,
  PERCENT_RANK() OVER (PARTITION BY dt ORDER BY volume ASC NULLS FIRST) AS volume_xs_rank
FROM silver""", floats=("roc_20_xs_rank", "volume_xs_rank"), ops=("E31",))
def q_xs_rank(spark, sf):
    """Cross-sectional percent rank per date."""
    df = E.with_roc(FX.bars_table(spark, sf), ns=(20,))
    return E.with_xs_rank(df, ["roc_20", "volume"]).select("ticker", "dt", "roc_20_xs_rank", "volume_xs_rank")


@register("sma_20", sql=S + f"SELECT ticker, dt, AVG(close) {rows(20)} AS sma_20 FROM silver",
          floats=("sma_20",), ops=("E15",))
def q_sma(spark, sf):
    """Simple moving average, 20 rows."""
    return E.with_sma(FX.bars_table(spark, sf)).select("ticker", "dt", "sma_20")


@register("sector_share", sql=with_ctes(BARS) + """
SELECT sector, COUNT(*) AS n, COUNT(*) * 100.0 / SUM(COUNT(*)) OVER () AS pct FROM bars GROUP BY sector""",
          floats=("pct",), ops=("E34",))
def q_sector_share(spark, sf):
    """Share of bars per sector."""
    g = FX.bars_table(spark, sf).groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    return E.pct_of_total(g, "n")


@register("grid_positions", sql=with_ctes(BARS).rstrip() + """,
c AS (SELECT ticker, sector, AVG(volume) AS avg_volume FROM bars WHERE sector IS NOT NULL GROUP BY ticker, sector),
p AS (SELECT ticker, sector, ROW_NUMBER() OVER (PARTITION BY sector ORDER BY avg_volume DESC, ticker) - 1 AS idx,
             COUNT(*) OVER (PARTITION BY sector) AS group_n FROM c)
SELECT ticker, sector, idx, group_n, CAST(CEIL(SQRT(group_n)) AS INTEGER) AS grid_cols,
       CAST(idx // CAST(CEIL(SQRT(group_n)) AS INTEGER) AS INTEGER) AS grid_row,
       CAST(idx % CAST(CEIL(SQRT(group_n)) AS INTEGER) AS INTEGER) AS grid_col
FROM p""", ops=("E36",))
def q_grid(spark, sf):
    """Position index and grid cell of each instrument inside its sector."""
    b = FX.bars_table(spark, sf).filter(F.col("sector").isNotNull())
    c = b.groupBy("ticker", "sector").agg(F.avg("volume").alias("avg_volume"))
    return E.grid_positions(c, "sector", [F.col("avg_volume").desc(), F.col("ticker")]).select(
        "ticker", "sector", "idx", "group_n", "grid_cols", "grid_row", "grid_col")


# The instruments of the matrix: its columns are part of the query.
PIVOT_TICKERS = ["BRAZIL", "CANADA", "CHINA", "EGYPT", "FRANCE", "GERMANY", "INDIA", "JAPAN", "KENYA", "MKT"]


@register("pivot_returns", sql=S + """
SELECT dt, """ + ", ".join(f"MAX(CASE WHEN ticker = '{t}' THEN daily_return END) AS \"{t}\"" for t in PIVOT_TICKERS) + """
FROM silver GROUP BY dt""", floats=tuple(PIVOT_TICKERS), ops=("D12",))
def q_pivot_returns(spark, sf):
    """Dates x instruments matrix of daily returns (first value per cell)."""
    from ..operators.aggregates import pivot_wide
    return pivot_wide(E.with_returns(FX.bars_table(spark, sf)), "dt", "ticker", "daily_return", PIVOT_TICKERS)
