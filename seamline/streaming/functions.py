"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .stateful import RunLengths

#: Arguments beside the table, with what they are unless given.
KNOBS = {"series": "series", "time": "t", "value": "value", "hazard": 0.01, "threshold": 0.5, "least": 10, "most": 250}


class DetectBreakpoints:
    """Rows of a table that begin a new run: its columns, then the row's number in its series and the probability.

    Whatever columns the table has, it is dealt by ``series`` and ordered by ``time`` by itself. Rows pass one by one; what is held is at most ``most`` runs.
    """

    def __init__(self, told: AnalyzeResult | None = None):
        self.runs, self.n, self.last = None, 0, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, **given: AnalyzeArgument) -> AnalyzeResult:
        unknown = set(given) - set(KNOBS)
        if unknown:
            raise ValueError(f"unknown arguments {sorted(unknown)}")
        knobs = KNOBS | {k: a.value for k, a in given.items()}
        missing = {knobs[k] for k in ("series", "time", "value")} - set(rows.dataType.names)
        if missing:
            raise ValueError(f"the table lacks {sorted(missing)}")
        schema = StructType([*rows.dataType.fields, StructField("row_number", LongType()), StructField("probability", DoubleType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(knobs["series"])], orderBy=[OrderingColumn(knobs["time"])])

    def eval(self, rows: Row, **given) -> Iterator[tuple]:
        knobs = KNOBS | given
        if rows[knobs["value"]] is None:
            return
        if self.runs is None:
            self.runs, self.last = RunLengths(1, float(knobs["hazard"]), int(knobs["most"])), -int(knobs["least"])
        p = self.runs.update(np.array([rows[knobs["value"]]], float))
        if self.n >= knobs["least"] and p >= knobs["threshold"] and self.n - self.last >= knobs["least"]:
            self.last = self.n
            yield (*rows, self.n, p)
        self.n += 1


def register(spark: SparkSession) -> None:
    """``select * from detect_breakpoints(table(panel), threshold => 0.5)``; a null value is passed over."""
    spark.udtf.register("detect_breakpoints", udtf(DetectBreakpoints))
