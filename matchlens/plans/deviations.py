"""The detectors wired to a set of match tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from matchlens.operators import build as B
from matchlens.operators import detectors as D
from matchlens.operators import events as E
from matchlens.operators import series as S
from matchlens.params import DEFAULTS, Thresholds
from matchlens.plans.share import keep


def late_items(tables, items: DataFrame, order: list[str], chunk: str | None = None,
               p: Thresholds = DEFAULTS) -> DataFrame:
    """Pace of the whole assembled build (no cost threshold) of every player.

    The pace reads the build several times; for logs of any size it is kept after the one pass
    that absorbs the components.
    """
    taken = B.absorb_components(B.with_items(tables.purchases, items), order, chunk)
    build = B.assembled(taken, 0)
    return B.pace_lag(keep(build) if chunk else build, tables.players, order, p, chunk)


def all_deviations(tables, items: DataFrame, lead: DataFrame, order: list[str], chunk: str | None = None,
                   p: Thresholds = DEFAULTS) -> list[DataFrame]:
    """The nine detectors in six passes. ``lead`` is the supplied advantage only."""
    players = tables.players
    return [
        D.item_lag(late_items(tables, items, order, chunk, p), p),
        D.bench_both(tables.benchmarks, p),
        D.farm_stall(S.longest_stall(tables.minutes, p), p),
        D.death_cluster(E.death_cluster(E.death_times(tables.kills, players), p), p),
        D.among_players(players, tables.matches, p),
        D.gold_collapse(S.worst_drop(lead, p), players, p),
    ]


def anomaly_topk(tables, items: DataFrame, lead: DataFrame, order: list[str], chunk: str | None = None,
                 p: Thresholds = DEFAULTS) -> DataFrame:
    return D.top_deviations(all_deviations(tables, items, lead, order, chunk, p), p)
