"""The signal table (gold): silver + flags, score, rarity, tiers, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import signals as S
from ..operators.windows import with_rarity


def signal_table(silver: DataFrame, params=None, top_kind="full") -> DataFrame:
    df = S.with_signals(silver, params)
    df = with_rarity(df)
    df = S.with_top_tier(df, params, top_kind)
    df = S.with_direction_bias(df)
    df = S.with_size_rank(df)
    df = S.with_dimensions(df)
    df = S.with_density(df)
    return df
