"""Registered queries: correlation graph (G1-G4, G6-G11, G13-G15, B12, C13,
C16, C18, H4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import windows as E
from ..operators.joins import induced_edges
from ..operators.ranking import cap_edges
from ..registry import register
from . import fixtures as FX
from .sqltext import BARS, SILVER, with_ctes

# Test settings: the invented prices are nearly uncorrelated (|corr| < 0.3
# at sf0.01), so the graph queries use looser edge thresholds than the
# defaults (0.5 / -0.3) to get a non-empty graph.
POS, NEG = 0.02, -0.02
SHOCK_SECTOR, SHOCK_MAG = "ASIA", -0.10
MIN_OBS = 60

PAIRS = f"""
gx AS (SELECT ticker, dt, daily_return AS r FROM silver WHERE daily_return IS NOT NULL),
gk AS (SELECT ticker FROM gx GROUP BY ticker HAVING COUNT(*) >= {MIN_OBS}),
gy AS (SELECT gx.* FROM gx WHERE ticker IN (SELECT ticker FROM gk)),
gp AS (SELECT a.ticker AS src, b.ticker AS dst, COUNT(*) AS n, SUM(a.r) AS sx, SUM(b.r) AS sy,
              SUM(a.r * a.r) AS sxx, SUM(b.r * b.r) AS syy, SUM(a.r * b.r) AS sxy
       FROM gy a JOIN gy b ON a.dt = b.dt AND a.ticker < b.ticker GROUP BY 1, 2),
pairs AS (
  SELECT src, dst, n, corr FROM (
    SELECT src, dst, n, CASE WHEN vx > 0 AND vy > 0 THEN cv / (SQRT(vx) * SQRT(vy)) END AS corr
    FROM (SELECT src, dst, n, CAST(n AS DOUBLE) * sxy - sx * sy AS cv, CAST(n AS DOUBLE) * sxx - sx * sx AS vx,
                 CAST(n AS DOUBLE) * syy - sy * sy AS vy FROM gp) WHERE n >= 2)
  WHERE corr IS NOT NULL),
edges AS (
  SELECT src, dst, corr AS weight, CASE WHEN corr >= 0 THEN 'positive' ELSE 'negative' END AS edge_type
  FROM pairs WHERE corr >= {POS} OR corr <= {NEG}),
nodes AS (SELECT ticker, MAX(sector) AS sector FROM silver GROUP BY ticker),
adj AS (SELECT src, dst, weight, edge_type FROM edges UNION ALL SELECT dst, src, weight, edge_type FROM edges)
"""
GS = with_ctes(BARS, SILVER, PAIRS)


def _returns(spark, sf):
    return E.with_returns(FX.bars_table(spark, sf))


def _pairs(spark, sf):
    return G.correlation_pairs(_returns(spark, sf), min_obs=MIN_OBS)


def _edges(spark, sf):
    pairs = G.correlation_pairs(_returns(spark, sf), min_obs=MIN_OBS, pos=POS, neg=NEG)
    return G.correlation_edges(pairs, POS, NEG)


def _nodes(spark, sf):
    return FX.bars_table(spark, sf).groupBy("ticker").agg(F.max("sector").alias("sector"))


@register("correlation_pairs", sql=GS + "SELECT src, dst, n, corr FROM pairs", floats=("corr",),
          ops=("G1", "C16"))
def q_pairs(spark, sf):
    """Pearson correlation of every instrument pair over common dates
    (block sufficient statistics; no per-date pair explosion)."""
    return _pairs(spark, sf)


@register("correlation_edges", sql=GS + "SELECT src, dst, weight, edge_type FROM edges", floats=("weight",),
          ops=("G3",))
def q_edges(spark, sf):
    """Signed edges above the thresholds."""
    return _edges(spark, sf)


@register("tail_correlation", sql=with_ctes(BARS, SILVER).rstrip() + f""",
tx AS (SELECT ticker, daily_return AS r,
                ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) AS pos
         FROM silver WHERE daily_return IS NOT NULL),
ty AS (SELECT * FROM tx WHERE pos <= 120 AND ticker IN (SELECT ticker FROM tx WHERE pos <= 120 GROUP BY ticker HAVING COUNT(*) >= 60)),
tp AS (SELECT a.ticker AS src, b.ticker AS dst, COUNT(*) AS n, SUM(a.r) AS sx, SUM(b.r) AS sy,
              SUM(a.r * a.r) AS sxx, SUM(b.r * b.r) AS syy, SUM(a.r * b.r) AS sxy
       FROM ty a JOIN ty b ON a.pos = b.pos AND a.ticker < b.ticker GROUP BY 1, 2)
SELECT src, dst, n, ABS(corr) AS corr FROM (
  SELECT src, dst, n, CASE WHEN vx > 0 AND vy > 0 THEN cv / (SQRT(vx) * SQRT(vy)) END AS corr
  FROM (SELECT src, dst, n, CAST(n AS DOUBLE) * sxy - sx * sy AS cv, CAST(n AS DOUBLE) * sxx - sx * sx AS vx,
               CAST(n AS DOUBLE) * syy - sy * sy AS vy FROM tp) WHERE n >= 2) WHERE corr IS NOT NULL""", floats=("corr",), ops=("G2",))
def q_tail_corr(spark, sf):
    """|corr| of the last 120 returns aligned by position from the end."""
    return G.tail_correlation(_returns(spark, sf))


@register("degree", sql=GS + """
SELECT n.ticker, COALESCE(d.pos_degree, 0) AS pos_degree, COALESCE(d.edge_count, 0) AS edge_count,
       CAST(COALESCE(d.pos_degree, 0) AS DOUBLE) / (COUNT(*) OVER () - 1) AS degree_centrality
FROM nodes n LEFT JOIN (SELECT src AS ticker, COUNT(*) FILTER (WHERE edge_type = 'positive') AS pos_degree,
                               COUNT(*) AS edge_count FROM adj GROUP BY src) d ON n.ticker = d.ticker""",
          floats=("degree_centrality",), ops=("G4",))
def q_degree(spark, sf):
    """Degree centrality (positive edges) and edge count per node."""
    return G.degree(_nodes(spark, sf), _edges(spark, sf))


def _shock_sql(max_hops=5, decay=0.6, min_impact=0.001):
    parts = [f"h0 AS (SELECT ticker AS source, ticker AS node, CAST({SHOCK_MAG} AS DOUBLE) AS impact, 0 AS hop, "
             f"CAST(NULL AS VARCHAR) AS parent FROM nodes WHERE sector = '{SHOCK_SECTOR}')",
             "r0 AS (SELECT * FROM h0)"]
    for h in range(1, max_hops + 1):
        parts.append(f"""c{h} AS (
  SELECT f.source, a.dst AS node,
         f.impact * ABS(a.weight) * CAST({decay} AS DOUBLE) * CASE WHEN a.weight < 0 THEN -1.0 ELSE 1.0 END AS impact,
         {h} AS hop, f.node AS parent
  FROM h{h - 1} f JOIN adj a ON f.node = a.src)""")
        parts.append(f"""h{h} AS (
  SELECT source, node, impact, hop, parent FROM (
    SELECT c.*, ROW_NUMBER() OVER (PARTITION BY c.source, c.node ORDER BY ABS(c.impact) DESC, c.parent) AS rr
    FROM c{h} c ANTI JOIN r{h - 1} r ON c.source = r.source AND c.node = r.node
    WHERE ABS(c.impact) >= {min_impact}) WHERE rr = 1)""")
        parts.append(f"r{h} AS (SELECT * FROM r{h - 1} UNION ALL SELECT * FROM h{h})")
    return ",\n".join(parts) + f"""
SELECT source, node, impact, hop, parent FROM (
  SELECT r{max_hops}.*, ROW_NUMBER() OVER (PARTITION BY node ORDER BY ABS(impact) DESC, source) AS rr
  FROM r{max_hops}) WHERE rr = 1"""


@register("propagate_shock", sql=GS.rstrip() + ",\n" + _shock_sql(), floats=("impact",), ops=("G8", "G9", "C18"))
def q_shock(spark, sf):
    """Sector-wide shock: every instrument of one sector at -10%, BFS over
    the graph (<= 5 hops), largest |impact| per node."""
    nodes = _nodes(spark, sf)
    src = nodes.filter(F.col("sector") == SHOCK_SECTOR).select(F.col("ticker").alias("source"),
                                                               F.lit(SHOCK_MAG).alias("magnitude"))
    return G.propagate_shock(_edges(spark, sf), src).select("source", "node", "impact", "hop", "parent")


@register("network_stats", sql=GS + """
SELECT (SELECT COUNT(*) FROM nodes) AS node_count, (SELECT COUNT(*) FROM edges) AS edge_count,
       (SELECT COUNT(*) FROM edges) * 2.0 / (SELECT COUNT(*) FROM nodes) AS avg_connections,
       CAST((SELECT COUNT(*) FROM edges) AS DOUBLE) / ((SELECT COUNT(*) FROM nodes) * ((SELECT COUNT(*) FROM nodes) - 1) / 2.0)
         AS density""", floats=("avg_connections", "density"), ops=("G14",))
def q_network_stats(spark, sf):
    """Node/edge counts, mean connections, density."""
    return G.network_stats(_nodes(spark, sf), _edges(spark, sf))


@register("neighbours_mkt", sql=GS + """
SELECT dst AS neighbour, weight, edge_type FROM adj WHERE src = 'MKT'""", floats=("weight",), ops=("G15",))
def q_neighbours(spark, sf):
    """Neighbours of the benchmark node."""
    return G.neighbours(_edges(spark, sf), "MKT")


@register("edges_high_vol", sql=GS.rstrip() + """,
vp AS (SELECT ticker, vol_percentile FROM (
  SELECT ticker, vol_percentile, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rr FROM silver) WHERE rr = 1)
SELECT e.src, e.dst, e.weight, e.edge_type FROM edges e
LEFT JOIN vp a ON e.src = a.ticker LEFT JOIN vp b ON e.dst = b.ticker
WHERE (COALESCE(a.vol_percentile, 0.5) + COALESCE(b.vol_percentile, 0.5)) / 2 > 0.6""",
          floats=("weight",), ops=("B12",))
def q_edges_high_vol(spark, sf):
    """Edges whose endpoints are, on average, in the high-volatility regime
    (latest volatility percentile of each instrument)."""
    from ..operators.ranking import latest_per_key
    from .silver import core_features
    vp = latest_per_key(core_features(FX.bars_table(spark, sf))).select("ticker", "vol_percentile")
    return G.filter_edges_by_vol(_edges(spark, sf), vp, "highVol")


@register("induced_edges", sql=GS + """
SELECT src, dst, weight, edge_type FROM edges
WHERE src IN (SELECT ticker FROM nodes WHERE sector IS NOT NULL)
  AND dst IN (SELECT ticker FROM nodes WHERE sector IS NOT NULL)""", floats=("weight",), ops=("C13",))
def q_induced(spark, sf):
    """Edges with both endpoints in the sector-mapped instrument set."""
    n = _nodes(spark, sf).filter(F.col("sector").isNotNull())
    return induced_edges(_edges(spark, sf), n)


@register("cap_edges", sql=GS + """
SELECT src, dst, weight, edge_type FROM edges ORDER BY ABS(weight) DESC, src, dst LIMIT 20""",
          floats=("weight",), ops=("H4",))
def q_cap_edges(spark, sf):
    """Strongest 20 edges by |weight|."""
    return cap_edges(_edges(spark, sf), 20)


def _pagerank_sql(iters=20, d=0.85):
    parts = ["""pw AS (SELECT src, SUM(ABS(weight)) AS out_w FROM adj GROUP BY src),
pa AS (SELECT a.src, a.dst, ABS(a.weight) / pw.out_w AS p FROM adj a JOIN pw ON a.src = pw.src),
pn AS (SELECT n.ticker AS node, pw.src IS NOT NULL AS has_out, COUNT(*) OVER () AS N
       FROM nodes n LEFT JOIN pw ON n.ticker = pw.src),
k0 AS (SELECT node, has_out, N, 1.0 / N AS rank FROM pn)"""]
    for i in range(1, iters + 1):
        parts.append(f"""k{i} AS (
  SELECT k.node, k.has_out, k.N,
         (1.0 - {d}) / k.N + {d} * (COALESCE(c.c, 0.0) + SUM(CASE WHEN NOT k.has_out THEN k.rank ELSE 0.0 END) OVER () / k.N) AS rank
  FROM k{i - 1} k LEFT JOIN (SELECT a.dst, SUM(k.rank * a.p) AS c FROM k{i - 1} k JOIN pa a ON k.node = a.src
                             GROUP BY a.dst) c ON k.node = c.dst)""")
    return ",\n".join(parts) + f"\nSELECT node AS ticker, rank AS pagerank FROM k{iters}"


@register("pagerank", sql=GS.rstrip() + ",\n" + _pagerank_sql(), floats=("pagerank",), ops=("G7",))
def q_pagerank(spark, sf):
    """Weighted PageRank, 20 iterations, damping 0.85."""
    return G.pagerank(_nodes(spark, sf), _edges(spark, sf), iters=20)


@register("eigenvector", ops=("G6",))
def q_eigenvector(spark, sf):
    """Eigenvector centrality by power iteration."""
    return G.eigenvector(_nodes(spark, sf), _edges(spark, sf))


@register("communities", ops=("G13",))
def q_communities(spark, sf):
    """Louvain communities over positive edges, with sizes."""
    return G.communities(_nodes(spark, sf), _edges(spark, sf))


@register("community_sectors", ops=("G13",))
def q_community_sectors(spark, sf):
    """Sector composition of each community."""
    n = _nodes(spark, sf)
    return G.community_sectors(G.communities(n, _edges(spark, sf)), n)


@register("intensity_shock", ops=("G10", "G11"))
def q_intensity(spark, sf):
    """Intensity BFS from the benchmark node, applied to the latest
    direction bias of every reached instrument (crash)."""
    from ..operators.ranking import latest_per_key
    from .gold import signal_table
    from .silver import daily_features, silver_table
    reached = G.intensity_shock(_edges(spark, sf), "MKT")
    g = latest_per_key(signal_table(silver_table(spark, sf)))
    return G.apply_shock(g.select("ticker", "buy_pct", "call_pct", "put_pct", "short_pct"), reached, "MKT")
