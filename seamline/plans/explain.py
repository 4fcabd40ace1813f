"""Trees that explain labels, and how breaks hold when columns are left out."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evaluation import detection
from ..functions.features import column_groups
from ..sources.scratch import written
from .segmentation import breaks_by_groups


def tree(rows: DataFrame, columns: list[str], depth: int = 3) -> tuple[DecisionTreeClassificationModel, DataFrame]:
    """A tree for ``label``, and ``rows`` with its ``predicted`` label. The model's ``toDebugString`` holds the rules."""
    v = VectorAssembler(inputCols=columns, outputCol="_v").transform(rows)
    model = DecisionTreeClassifier(featuresCol="_v", labelCol="label", predictionCol="_p", maxDepth=depth, maxBins=256, seed=0).fit(v)
    return model, model.transform(v).select(*rows.columns, F.col("_p").cast("int").alias("predicted"))


def tree_for(rows: DataFrame, columns: list[str], accuracy: float = 0.95, deepest: int = 20) -> tuple[int, DecisionTreeClassificationModel, DataFrame]:
    """The shallowest tree that reaches ``accuracy`` on its own rows, else the deepest one."""
    for depth in range(1, deepest + 1):
        model, out = tree(rows, columns, depth)
        right = out.agg(F.avg((F.col("label") == F.col("predicted")).cast("int"))).first()[0]
        if right is None or right >= accuracy:
            break
    return depth, model, out


def without_groups(panel: DataFrame, columns: list[str], tolerance: int = 5, **knobs) -> DataFrame:
    """(run, precision, recall, f1, recovery) of the breaks found without each source or tenor, against those of all columns.

    A run is a series and what it is without. Where neither side has a break all four are 1.
    """
    left = {name: [c for c in columns if c not in group] for name, group in column_groups(columns).items() if name != "all"}
    left = {name: cols for name, cols in left.items() if cols}
    if not left:
        raise ValueError("no column group can be left out")
    found = written(breaks_by_groups(panel, {"": columns, **left}, **knobs), "groups")
    key = lambda run: F.concat_ws(" without ", F.col("series"), run)
    base = found.where("run = ''").withColumn("run", F.explode(F.array(*map(F.lit, left)))).select(key(F.col("run")).alias("series"), "b")
    runs = found.where("run <> ''").select(key(F.col("run")).alias("series"), (F.col("b") + 0).alias("b"))  # another column than the base's, for the cogroup
    every = panel.select("series").distinct().withColumn("run", F.explode(F.array(*map(F.lit, left)))).select(key(F.col("run")).alias("series"))
    return every.join(detection(base, runs, tolerance), "series", "left").na.fill(1.0).withColumnRenamed("series", "run")


def leaf_masses(model: DecisionTreeClassificationModel, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(leaf, label, mass): the rows of each regime that end in each leaf, a leaf being told by its distribution."""
    v = VectorAssembler(inputCols=columns, outputCol="_v").transform(rows)
    return model.transform(v).groupBy(vector_to_array("rawPrediction").alias("leaf"), "label").agg(F.count(F.lit(1)).alias("mass"))


def in_basis_points(rows: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rates in percent as basis points, a hundred times; columns in ``keep`` stay."""
    return rows.withColumns({c: F.col(c) * 100 for c in columns if c not in keep})
