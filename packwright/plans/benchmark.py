"""Times of searches in the packs of a workspace."""

from __future__ import annotations

import time
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.operators.stats import position_quantile

if TYPE_CHECKING:
    from packwright.api import Engine

# The names that packs of a role are asked for.
ASKED = {
    "platform": ("Глобальный контекст.ПрочитатьJSON", "HTTPСоединение.Получить", "ТаблицаЗначений"),
    "metadata": ("Document.РеализацияТоваровУслуг", "Организация", "Товары"),
}


def search_times(engine: Engine, loops: int = 5) -> DataFrame:
    """(pack, runs, avg_ms, p95_ms) of searches, ``loops`` times each name, in the platform pack and each target's metadata pack.

    A search counts until its rows are there. Packs that the workspace lacks have no row; no loops give no rows.
    """
    packs = [("platform", None)] if "platform" in engine.workspace.packs else []
    packs += [("metadata", name) for name, t in sorted(engine.workspace.targets.items()) if "metadata" in t["packs"]]
    taken = []
    for role, target in packs:
        for q in ASKED[role] * loops:
            began = time.perf_counter()
            engine.search(q, role, target=target, limit=5).collect()  # at most five rows
            taken.append((target or role, (time.perf_counter() - began) * 1000))
    rows = engine.spark.createDataFrame(taken, "pack string, ms double")
    spread = position_quantile(rows, "pack", "ms").select("pack", F.round("average", 2).alias("avg_ms"), F.round("at_quantile", 2).alias("p95_ms"))
    return rows.groupBy("pack").agg(F.count(F.lit(1)).alias("runs")).join(spread, "pack").orderBy("pack")
