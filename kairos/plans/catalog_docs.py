"""Registered queries: JSON documents (A14-A17). Rows-only checks: the
document text is engine-specific; tests parse it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import ml as N
from ..registry import register
from ..sources import load
from . import fixtures as FX
from . import payload as PL
from .gold import signal_table
from .silver import daily_features, silver_table


@register("snapshot_payload", ops=("A14", "B3", "B4", "B10", "L12"))
def q_snapshot(spark, sf):
    """Snapshot documents: latest row per instrument, one JSON per sector."""
    return PL.build_snapshot_payload(signal_table(silver_table(spark, sf)))


@register("graph_payload", ops=("A15", "G13"))
def q_graph_payload(spark, sf):
    """Graph documents: one JSON per node with its edges and community."""
    from .catalog_graph import _edges, _nodes
    nodes, edges = _nodes(spark, sf), _edges(spark, sf)
    return PL.build_graph_payload(nodes, edges, G.communities(nodes, edges))


@register("scenario_payload", ops=("A16",))
def q_scenario_payload(spark, sf):
    """Scenario documents: dates with regime and instruments by agents."""
    from ..operators.decide import aggregate_flows
    from .catalog_decide import flows
    agg = aggregate_flows(flows(spark, sf))
    reg = FX.regimes(silver_table(spark, sf))
    return PL.build_scenario_payload(agg, reg)


@register("topic_metadata", ops=("A17",))
def q_topic_metadata(spark, sf):
    """Topic metadata document from the language-class keywords."""
    d = N.class_topics(load(spark, sf, "documents"))
    return PL.build_topic_metadata(N.assign_topics(N.topic_words(d)))
