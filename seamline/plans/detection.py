"""The whole run: reduce a panel, map it, search by a cost, test and recurse, over a grid of choices."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.maps import kernel_costed, mapped
from ..operators.reduce import principal_components, rank_of
from ..operators.twosample import differences
from ..sources.scratch import written
from .segmentation import segment


def reduced(panel: DataFrame, columns: list[str], how: str = "raw", explained: float = 0.95) -> tuple[DataFrame, list[str]]:
    """The panel and the columns that stand for it: themselves (``raw``), or as many principal components as explain the share (``pca``)."""
    if how == "raw":
        return panel, list(columns)
    if how == "pca":
        k = rank_of(panel, columns, explained)
        return principal_components(panel, columns, k), [f"pc{i + 1}" for i in range(k)]
    raise ValueError(f"unknown reduction {how!r}")


def detect(
    panel: DataFrame,
    columns: list[str] | None = None,
    reductions: list[str] = ("raw",),
    maps: list[dict] = ({"to": "raw"},),
    costs: list[dict] = ({"cost": "rbf", "gamma": "median"},),
    configs: dict[str, dict] | None = None,
    diffs: bool = False,
) -> DataFrame:
    """Breaks of every series under every combination of choices: (series, run, b, level, stat, p, status), as ``segment`` says.

    Each of ``reductions`` (``reduced``) is mapped by each of ``maps`` (``maps.mapped``, ``maps.map_grid``); the mapped rows are tested, and searched by each of
    ``costs`` (``maps.kernel_costed``) under all ``configs`` in one segmentation. ``run`` names the choices that differ and the configuration. With ``diffs`` first differences
    take the rows' place; a break b is then between rows b and b + 1 of the panel.
    """
    columns, configs = list(columns or ["value"]), configs or {"base": {}}
    rows = panel.select("series", "t", *columns)
    if diffs:
        rows = differences(rows, tuple(columns)).withColumn("t", F.col("t") - 1)
    runs = []
    for how in reductions:
        own, names = reduced(rows, columns, how)
        for i, given in enumerate(maps):
            z = written(mapped(own, names, **given), "mapped")
            for k, cost in enumerate(costs):
                costed, searched = kernel_costed(z, "z", **cost)
                costed = written(costed, "costed") if searched != "z" else costed
                part = [x for x, many in ((how, len(reductions)), (f"{given.get('to', 'raw')}{i}", len(maps)), (f"{cost.get('cost', 'l2')}{k}", len(costs))) if many > 1]
                found = segment(costed, "z", configs, searched=searched)
                runs.append(found.withColumn("run", F.concat_ws(" ", *map(F.lit, part), "run")))
    return fold(DataFrame.union, runs)
