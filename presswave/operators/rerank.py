"""Order-dependent rerankers of feeds: each pick changes later scores, so a window cannot say it.

Every feed (a reader's, a day's) is a group of its own, cut to its ``pool`` best rows by a distributed top-k
first: the pool is the feature, and it bounds the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswave.operators.relational import top_k

POOL = 2000


def _by_feed(df: DataFrame, feed: str, score: str, key: str, pool: int, run) -> DataFrame:
    top = top_k(df, [feed], [F.desc(score), F.col(key)], pool)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in top.schema) + ", place int"
    return top.groupBy(feed).applyInPandas(lambda p: run(p.sort_values([score, key], ascending=[False, True])), schema)


def rest_sources(names: list, cooldown: int) -> list[int]:
    """Positions of rows in an order in which a source is free again from the ``cooldown``-th pick after its own; without a free one, the source longest ago."""
    last, order, rest = {}, [], list(range(len(names)))
    while rest:
        at = len(order)
        free = next((i for i in rest if at - last.get(names[i], -cooldown) >= cooldown), None)
        pick = free if free is not None else min(rest, key=lambda i: last[names[i]])
        last[names[pick]] = at
        order.append(pick)
        rest.remove(pick)
    return order


def diversity_rerank(df: DataFrame, feed: str, score: str, key: str, source: str, cooldown: int = 5, pool: int = POOL) -> DataFrame:
    """The best row whose source was not among the last ``cooldown`` - 1 picks; without one, the source longest ago."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return p.iloc[rest_sources(p[source].to_list(), cooldown)].assign(place=range(1, len(p) + 1))

    return _by_feed(df, feed, score, key, pool, run)


def newness(at: pd.Series) -> np.ndarray:
    """1.5 for the newest row down to 1 for the oldest."""
    age = (at.max() - at).dt.total_seconds().to_numpy(dtype=float)
    return 1.5 - 0.5 * age / (age.max() or 1.0)


def variance_rerank(df: DataFrame, feed: str, score: str, key: str, country: str, published: str, penalty: float = 1.5, fade: float = 0.25, most_in_row: int = 2, pool: int = POOL) -> DataFrame:
    """Newer rows weigh up to half more; a picked country's rows count (1 - penalty) times.

    The penalty fades by ``fade`` of itself with each later pick and ends below 0.01; at most ``most_in_row`` of one
    country stand in a row, unless nothing else is left.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        countries = pd.factorize(p[country], use_na_sentinel=False)[0]
        weight, fines = p[score].to_numpy(dtype=float) * newness(p[published]), np.zeros(countries.max() + 1)
        left, order = np.ones(len(p), dtype=bool), []
        for _ in range(len(p)):
            able = left
            tail = {countries[k] for k in order[-most_in_row:]}
            if len(order) >= most_in_row and len(tail) == 1:
                able = left & (countries != tail.pop())
            pick = int(np.where(able, weight * (1 - fines[countries]), -np.inf).argmax()) if able.any() else int(left.argmax())
            left[pick] = False
            order.append(pick)
            fines *= 1 - fade
            fines[fines < 0.01] = 0.0
            fines[countries[pick]] = penalty
        return p.iloc[order].assign(place=range(1, len(p) + 1))

    return _by_feed(df, feed, score, key, pool, run)


def combined_rerank(df: DataFrame, feed: str, score: str, key: str, source: str, country: str, published: str, pool: int = POOL, penalty: float = 2.0, fade: float = 0.15) -> DataFrame:
    """Newer rows weigh up to half more; a source comes again only when no other is left, a country not twice in a row.

    A picked country's rows count (1 - penalty) times, and the penalty fades by ``fade`` with each pick. Where
    nothing is free, the source picked longest ago comes first, then the score.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        n, order = len(p), []
        sources, countries = pd.factorize(p[source], use_na_sentinel=False)[0], pd.factorize(p[country], use_na_sentinel=False)[0]
        weight = p[score].to_numpy(dtype=float) * newness(p[published])
        source_at, country_at, left = np.full(n, -n), np.full(n, -n), np.ones(n, dtype=bool)
        for at in range(n):
            rest = np.where(source_at[sources] > -n, n - (at - source_at[sources]), 0)  # turns until a source is free
            faded = penalty * (1 - fade) ** (at - 1 - country_at[countries].astype(float))
            value = weight * (1 - np.where((country_at[countries] > -n) & (faded >= 0.01), faded, 0.0))
            free = left & (rest == 0)
            if order:
                free &= countries != countries[order[-1]]
            if not free.any():
                free = left & (rest == rest[left].min())
            pick = int(np.where(free, value, -np.inf).argmax())
            left[pick] = False
            source_at[sources[pick]] = country_at[countries[pick]] = at
            order.append(pick)
        return p.iloc[order].assign(place=range(1, n + 1))

    return _by_feed(df, feed, score, key, pool, run)


def city_window(cities: list[bool], window: int = 20, cap: int = 1) -> tuple[list[int], list[int]]:
    """Positions in an order in which at most ``cap`` city rows stand among ``window`` neighbours, and those put off."""
    kept, late, recent = [], [], []
    for k, city in enumerate(cities):
        if city and sum(recent) >= cap:
            late.append(k)
            continue
        kept.append(k)
        recent = [*recent, city][-window:]
    return kept, late


def rank_feed(df: DataFrame, feed: str, score: str, key: str, source: str, city: str, published: str, cooldown: int = 5, pool: int = POOL) -> DataFrame:
    """Rows by score in steps of 0.001 (then the newer, then ``key``), sources resting between picks, cities spread out.

    Steps stand for a tolerance between neighbours, which would not be an order; cities put off follow by score.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(__step=np.floor(p[score].astype(float) / 0.001)).sort_values(["__step", published, key], ascending=[False, False, True]).drop(columns="__step")
        p = p.iloc[rest_sources(p[source].to_list(), cooldown)]
        kept, late = city_window(p[city].astype(bool).to_list())
        late.sort(key=lambda k: -p[score].iloc[k])
        return p.iloc[kept + late].assign(place=range(1, len(p) + 1))

    return _by_feed(df, feed, score, key, pool, run)
