"""Records against what is recomputed from raw samples: each problem is a row, a sound record gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import isclose


def problems(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and problem for every rule that does not hold; what cannot be judged (null) does not hold."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return rows.select(*keys, F.explode(failed).alias("problem"))


def throughput(points: DataFrame, noted: DataFrame, plateaus: DataFrame, headlines: DataFrame, rel: float = 1e-9) -> DataFrame:
    """codec, copies (null for a headline) and problem of a throughput record.

    points and noted: codec, copies, value, cv, recomputed and recorded; plateaus and headlines: codec, plateau, value, reason.
    A headline is the last point's value if there is a plateau; else it has no value, but a reason.
    """
    both = points.join(noted.select("codec", "copies", F.col("value").alias("nv"), F.col("cv").alias("nc")), ["codec", "copies"], "left")
    of_points = problems(both, ["codec", "copies"], {"rate": isclose(F.col("value"), F.col("nv"), rel, 0.0), "spread": isclose(F.col("cv"), F.col("nc"), rel, 0.0)})
    heads = plateaus.select("codec", F.col("plateau").alias("p"), F.col("value").alias("v"))
    heads = heads.join(headlines.select("codec", "plateau", F.col("value").alias("nv"), "reason"), "codec", "left")
    rules = {
        "plateau": F.col("p") == F.col("plateau"),
        "headline": F.when(F.col("p"), isclose(F.col("v"), F.col("nv"), rel, 0.0)).otherwise(F.col("nv").isNull()),
        "reason": F.col("p") | (F.length(F.trim("reason")) > 0),
    }
    return of_points.unionByName(problems(heads.withColumn("copies", F.lit(None).cast("long")), ["codec", "copies"], rules))
