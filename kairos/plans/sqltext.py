"""DuckDB/ANSI SQL text of the derived inputs, shared by the oracles."""

BARS = """
bars AS (
  WITH t AS (
    SELECT n_name AS ticker, r_name AS sector, CAST(l_shipdate AS DATE) AS dt,
           l_extendedprice / l_quantity AS px, l_quantity AS qty,
           l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  u AS (
    SELECT * FROM t
    UNION ALL
    SELECT 'MKT', CAST(NULL AS VARCHAR), dt, px, qty,
           l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM t),
  p AS (
    SELECT u.*,
           ROW_NUMBER() OVER (PARTITION BY ticker, dt
             ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
           COUNT(*) OVER (PARTITION BY ticker, dt) AS n
    FROM u)
  SELECT ticker, MAX(sector) AS sector, dt,
         MAX(CASE WHEN rn = 1 THEN px END) AS open, MAX(px) AS high, MIN(px) AS low,
         MAX(CASE WHEN rn = n THEN px END) AS close, CAST(SUM(qty) AS BIGINT) AS volume
  FROM p GROUP BY ticker, dt)
"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"

W = "PARTITION BY ticker ORDER BY dt"


def rows(n: int) -> str:
    """Trailing frame of n rows (DuckDB text)."""
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def dbl(x: float) -> str:
    """An exact DOUBLE literal."""
    return f"CAST('{x!r}' AS DOUBLE)"


SQRT252 = "sqrt(252.0)"

# The silver feature table, SPK variant, as DuckDB text.
SILVER = f"""
s1 AS (
  SELECT b.*, LAG(close) OVER ({W}) AS prev_close,
         MAX(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_max,
         LAG(close, 5) OVER ({W}) AS close_l5, LAG(close, 20) OVER ({W}) AS close_l20,
         LAG(close, 60) OVER ({W}) AS close_l60,
         LEAD(close, 5) OVER ({W}) AS close_f5, LEAD(close, 20) OVER ({W}) AS close_f20,
         LEAD(close, 60) OVER ({W}) AS close_f60,
         AVG(close) {rows(12)} AS ema_12, AVG(close) {rows(26)} AS ema_26,
         AVG(close) {rows(20)} AS bb_mid, STDDEV_SAMP(close) {rows(20)} AS bb_std,
         AVG(close) {rows(60)} AS mean_60d, STDDEV_SAMP(close) {rows(60)} AS std_60d
  FROM bars b),
s2 AS (
  SELECT s1.*,
         (close - prev_close) / NULLIF(prev_close, 0) AS daily_return,
         LN(close / NULLIF(prev_close, 0)) AS log_return,
         (close - running_max) / NULLIF(running_max, 0) AS drawdown_pct,
         GREATEST(high - low, ABS(high - prev_close), ABS(low - prev_close)) AS true_range,
         ema_12 - ema_26 AS macd_line,
         bb_mid + 2.0 * bb_std AS bb_upper, bb_mid - 2.0 * bb_std AS bb_lower,
         (close - close_l5) / NULLIF(close_l5, 0) AS roc_5,
         (close - close_l20) / NULLIF(close_l20, 0) AS roc_20,
         (close - close_l60) / NULLIF(close_l60, 0) AS roc_60,
         CASE WHEN bb_std > 0 THEN (close - bb_mid) / bb_std ELSE 0.0 END AS zscore_20d,
         CASE WHEN std_60d > 0 THEN (close - mean_60d) / std_60d ELSE 0.0 END AS zscore_60d,
         (close_f5 - close) / NULLIF(close, 0) AS fwd_return_5d,
         (close_f20 - close) / NULLIF(close, 0) AS fwd_return_20d,
         (close_f60 - close) / NULLIF(close, 0) AS fwd_return_60d
  FROM s1),
s3 AS (
  SELECT s2.*,
         STDDEV_SAMP(daily_return) {rows(20)} * {SQRT252} AS realized_vol_20d,
         STDDEV_SAMP(daily_return) {rows(60)} * {SQRT252} AS realized_vol_60d,
         CASE WHEN daily_return > 0 THEN daily_return ELSE 0.0 END AS gain,
         CASE WHEN daily_return < 0 THEN -daily_return ELSE 0.0 END AS loss,
         AVG(macd_line) {rows(9)} AS macd_signal,
         CASE WHEN bb_std > 0 THEN (close - bb_lower) / NULLIF(bb_upper - bb_lower, 0) ELSE 0.5 END AS bb_pct_b,
         (bb_upper - bb_lower) / NULLIF(bb_mid, 0) AS bb_width,
         AVG(true_range) {rows(14)} AS atr_14,
         SUM(daily_return) {rows(20)} AS rolling_return_20d,
         COUNT(daily_return) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS fwd_n,
         QUANTILE_CONT(daily_return, [0.05, 0.25, 0.5, 0.75, 0.95])
           OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS fwd_q,
         AVG(daily_return) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS fwd_m1,
         AVG(daily_return * daily_return) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS fwd_m2,
         AVG(daily_return * daily_return * daily_return)
           OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS fwd_m3
  FROM s2),
s4 AS (
  SELECT s3.*,
         AVG(gain) {rows(14)} AS avg_gain_14, AVG(loss) {rows(14)} AS avg_loss_14,
         macd_line - macd_signal AS macd_histogram,
         LAG(rolling_return_20d) OVER ({W}) AS rolling_return_lag1,
         CASE WHEN fwd_n >= 10 THEN
           (fwd_m3 - 3 * fwd_m1 * fwd_m2 + 2 * fwd_m1 * fwd_m1 * fwd_m1)
           / NULLIF(POW(fwd_m2 - fwd_m1 * fwd_m1, 1.5), 0) END AS fwd_60d_skew,
         CASE WHEN fwd_n >= 10 THEN fwd_q[1] END AS fwd_60d_p5,
         CASE WHEN fwd_n >= 10 THEN fwd_q[2] END AS fwd_60d_p25,
         CASE WHEN fwd_n >= 10 THEN fwd_q[3] END AS fwd_60d_median,
         CASE WHEN fwd_n >= 10 THEN fwd_q[4] END AS fwd_60d_p75,
         CASE WHEN fwd_n >= 10 THEN fwd_q[5] END AS fwd_60d_p95,
         PERCENT_RANK() OVER (PARTITION BY ticker ORDER BY drawdown_pct ASC NULLS FIRST) AS drawdown_percentile,
         PERCENT_RANK() OVER (PARTITION BY ticker ORDER BY ROUND(realized_vol_20d * 1e10) / 1e10 ASC NULLS FIRST) AS vol_percentile,
         PERCENT_RANK() OVER (PARTITION BY ticker ORDER BY volume ASC NULLS FIRST) AS volume_percentile,
         QUANTILE_CONT(drawdown_pct, 0.5) OVER (PARTITION BY ticker) AS median_drawdown
  FROM s3),
s5 AS (
  SELECT s4.*,
         100.0 - 100.0 / (1.0 + CASE WHEN avg_loss_14 > 0 THEN avg_gain_14 / avg_loss_14 ELSE 100.0 END) AS rsi_14,
         COVAR_POP(CASE WHEN rolling_return_lag1 IS NOT NULL THEN rolling_return_20d END,
                   CASE WHEN rolling_return_20d IS NOT NULL THEN rolling_return_lag1 END) {rows(60)}
         / NULLIF(STDDEV_POP(CASE WHEN rolling_return_lag1 IS NOT NULL THEN rolling_return_20d END) {rows(60)}
                * STDDEV_POP(CASE WHEN rolling_return_20d IS NOT NULL THEN rolling_return_lag1 END) {rows(60)}, 0)
           AS mean_reversion_score
  FROM s4),
bench AS (
  SELECT dt AS bdt, daily_return AS bench_return, close AS bench_close,
         realized_vol_20d AS bench_vol_20d,
         QUANTILE_CONT(realized_vol_20d, 0.8) OVER () AS bench_vol_threshold
  FROM s5 WHERE ticker = 'MKT'),
s6 AS (
  SELECT s5.*, bench.bench_return, bench.bench_close, bench.bench_vol_20d, bench.bench_vol_threshold,
         s5.daily_return - bench.bench_return AS relative_return,
         CASE WHEN bench.bench_vol_20d < bench.bench_vol_threshold THEN 'favorable' ELSE 'elevated' END AS vol_regime
  FROM s5 LEFT JOIN bench ON s5.dt = bench.bdt),
s7 AS (
  SELECT s6.*, SUM(relative_return) {rows(20)} AS relative_return_20d FROM s6),
silver AS (
  SELECT s7.*,
         PERCENT_RANK() OVER (PARTITION BY ticker ORDER BY ROUND(relative_return_20d * 1e10) / 1e10 ASC NULLS FIRST)
           AS relative_return_percentile
  FROM s7)
"""

# The signal table (gold) on top of SILVER.
GOLD = """
g1 AS (
  SELECT silver.*,
    COALESCE(drawdown_percentile > 0.8, FALSE) AS signal_1,
    COALESCE(drawdown_percentile > 0.85 AND volume_percentile > 0.9 AND vol_percentile > 0.85, FALSE) AS signal_2,
    COALESCE(drawdown_percentile > 0.85 AND fwd_60d_skew > 0.0 AND fwd_60d_p95 > 2.0 * fwd_60d_median
             AND fwd_60d_p5 > median_drawdown, FALSE) AS signal_3,
    COALESCE(drawdown_percentile > 0.8 AND relative_return_percentile < 0.15
             AND mean_reversion_score < -0.1, FALSE) AS signal_4,
    COALESCE(drawdown_percentile > 0.9 AND volume_percentile > 0.9 AND relative_return_percentile < 0.15
             AND fwd_60d_skew > 0.5 AND vol_regime = 'favorable', FALSE) AS signal_5
  FROM silver),
g2 AS (
  SELECT g1.*, CAST(signal_1 AS INTEGER) + CAST(signal_2 AS INTEGER) + CAST(signal_3 AS INTEGER)
               + CAST(signal_4 AS INTEGER) + CAST(signal_5 AS INTEGER) AS signal_score
  FROM g1),
g3 AS (
  SELECT g2.*, PERCENT_RANK() OVER (PARTITION BY dt ORDER BY signal_score ASC NULLS FIRST,
                                    drawdown_percentile ASC NULLS FIRST) AS rarity_percentile
  FROM g2),
g4 AS (
  SELECT g3.*,
    COALESCE(signal_score >= 4 AND rarity_percentile > 0.98 AND fwd_60d_skew > 1.0
             AND relative_return_percentile < 0.05 AND vol_regime = 'favorable', FALSE) AS top_tier,
    CASE WHEN fwd_60d_skew > 0.5 AND fwd_60d_median > 0.02 THEN 0.5
         WHEN fwd_60d_skew > 0.3 AND ABS(fwd_60d_median) < 0.02 THEN 0.2
         WHEN fwd_60d_skew < -0.3 THEN 0.1 ELSE 0.3 END AS buy_pct,
    CASE WHEN fwd_60d_skew > 0.5 AND fwd_60d_median > 0.02 THEN 0.3
         WHEN fwd_60d_skew > 0.3 AND ABS(fwd_60d_median) < 0.02 THEN 0.5
         WHEN fwd_60d_skew < -0.3 THEN 0.1 ELSE 0.25 END AS call_pct,
    CASE WHEN fwd_60d_skew > 0.5 AND fwd_60d_median > 0.02 THEN 0.1
         WHEN fwd_60d_skew > 0.3 AND ABS(fwd_60d_median) < 0.02 THEN 0.2
         WHEN fwd_60d_skew < -0.3 THEN 0.45 ELSE 0.25 END AS put_pct,
    CASE WHEN fwd_60d_skew > 0.5 AND fwd_60d_median > 0.02 THEN 0.1
         WHEN fwd_60d_skew > 0.3 AND ABS(fwd_60d_median) < 0.02 THEN 0.1
         WHEN fwd_60d_skew < -0.3 THEN 0.35 ELSE 0.2 END AS short_pct
  FROM g3),
sz AS (
  SELECT ticker, PERCENT_RANK() OVER (ORDER BY avg_volume ASC NULLS FIRST) AS size_percentile
  FROM (SELECT ticker, AVG(volume) AS avg_volume FROM bars GROUP BY ticker)),
g5 AS (
  SELECT g4.*, sz.size_percentile,
    1.0 + sz.size_percentile * 2.0 AS w0, 1.5 + sz.size_percentile * 2.5 AS h0,
    1.0 + sz.size_percentile * 1.0 AS d0,
    CAST(200 + FLOOR(POW(CAST(signal_score AS DOUBLE), 2.5) * 800) AS BIGINT) AS dens0
  FROM g4 LEFT JOIN sz ON g4.ticker = sz.ticker),
gold AS (
  SELECT g5.* EXCLUDE (w0, h0, d0, dens0),
    CASE WHEN top_tier THEN w0 * 2.5 ELSE w0 END AS width,
    CASE WHEN top_tier THEN h0 * 2.5 ELSE h0 END AS height,
    CASE WHEN top_tier THEN d0 * 2.5 ELSE d0 END AS depth,
    CAST(signal_score AS DOUBLE) / 5.0 AS glow,
    CASE WHEN top_tier THEN CAST(dens0 * 3 AS BIGINT) ELSE dens0 END AS density,
    1.0 + CAST(signal_score AS DOUBLE) * 1.5 AS speed
  FROM g5)
"""
