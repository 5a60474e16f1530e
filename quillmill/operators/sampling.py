"""Samples and reports: a fixed number of rows a stratum, manifest coverage, differences between two reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified(rows: DataFrame, strata: list[str], key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows of each stratum, the same for the same keys and seed whatever their order.

    Rows are ranked by a digest of their key. Each partition's best are kept before the shuffle (Catalyst's group
    limit), so a stratum of any size moves at most n rows a partition.
    """
    w = Window.partitionBy(*strata).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def coverage(manifest: DataFrame, results: DataFrame, key: str, split: str) -> DataFrame:
    """``(split, items, evaluated, missing)`` of a manifest; results without an item are counted under a null split."""
    done = results.select(key).distinct().withColumn("__done", F.lit(1))
    x = manifest.select(key, split).distinct().withColumn("__item", F.lit(1)).join(done, key, "full")
    return x.groupBy(split).agg(F.count("__item").alias("items"), F.count("__done").alias("evaluated"), F.count_if(F.col("__done").isNull()).alias("missing"))


def compare_reports(before: DataFrame, after: DataFrame, key: str = "metric", value: str = "value", tolerance: float = 0.0) -> DataFrame:
    """``(metric, before, after, change, verdict)``: better, worse or same; a metric of one report only is new or gone. Larger is better."""
    b, a = (d.select(key, F.col(value).cast("double").alias(n)) for d, n in ((before, "before"), (after, "after")))
    x = b.join(a, key, "full").withColumn("change", F.col("after") - F.col("before"))
    verdict = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("change") > tolerance, "better").when(F.col("change") < -tolerance, "worse").otherwise("same")
    return x.withColumn("verdict", verdict)
