"""Evaluation of detected types against ground truth, by prompt, by type and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detected(masked: Column, skipped: Column) -> tuple[Column, Column]:
    """Types masked (without the second layer's), and types logged."""
    types = F.array_sort(F.array_distinct(F.transform(F.filter(masked, lambda m: m["entity_type"] != "ML_FLAGGED_ANOMALY"), lambda m: m["entity_type"])))
    logged = F.array_sort(F.array_distinct(F.transform(F.filter(skipped, lambda s: s["reason"] == "low_confidence_logged"), lambda s: s["entity_type"])))
    return types, logged


def by_prompt(df: DataFrame, truth: str = "entities", keys: tuple[str, ...] = ("id", "type")) -> DataFrame:
    """keys, ground_truth, detected_masked, detected_logged (pipe-joined), overall_risk, tp, fp, fn."""
    masked, logged = detected(F.col("masked"), F.col("skipped"))
    out = df.select(*keys, F.col(truth).alias("_t"), masked.alias("_m"), logged.alias("_l"), "overall_risk")
    out = out.withColumn("_d", F.array_union("_m", "_l"))
    join = lambda c: F.array_join(F.array_sort(c), "|")
    return out.select(*keys, join("_t").alias("ground_truth"), join("_m").alias("detected_masked"), join("_l").alias("detected_logged"), "overall_risk", F.size(F.array_intersect("_t", "_d")).alias("tp"), F.size(F.array_except("_d", "_t")).alias("fp"), F.size(F.array_except("_t", "_d")).alias("fn"))


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def by_type(df: DataFrame, truth: Column, found: Column) -> DataFrame:
    """entity_type (null: all), tp, fp, fn, precision, recall, f1 from two arrays of types: one partial aggregate."""
    each = df.select(truth.alias("t"), found.alias("d")).select(F.explode(F.array_distinct(F.concat("t", "d"))).alias("entity_type"), "t", "d")
    hit, real = F.array_contains("d", F.col("entity_type")), F.array_contains("t", F.col("entity_type"))
    count = lambda c: F.sum(c.cast("long"))
    sums = each.rollup("entity_type").agg(count(hit & real).alias("tp"), count(hit & ~real).alias("fp"), count(~hit & real).alias("fn"))
    return sums.select("entity_type", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def actions(df: DataFrame) -> DataFrame:
    """action, n over all resolved entities."""
    return df.select(F.explode("resolved").alias("e")).groupBy(F.col("e.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def special_rates(df: DataFrame, kind: str = "type", note: str = "note") -> DataFrame:
    """adversarial_rate and edge_fp_rate in percent; 0 where there are no such prompts."""
    found = (F.size("masked") > 0) | F.exists("skipped", lambda s: s["reason"] == "low_confidence_logged")
    adversarial, edge = F.col(kind) == "adversarial", (F.col(kind) == "edge") & F.contains(F.col(note), F.lit("should NOT"))
    share = lambda of, hit: F.coalesce(F.try_divide(100.0 * F.count_if(of & hit), F.count_if(of)), F.lit(0.0))
    return df.agg(share(adversarial, found).alias("adversarial_rate"), share(edge, F.size("masked") > 0).alias("edge_fp_rate"))


def second_layer(df: DataFrame, truth: str = "entities") -> DataFrame:
    """flagged, masked, review and false alarms of the second layer."""
    span = F.exists("masked", lambda m: m["entity_type"] == "ML_FLAGGED_ANOMALY")
    return df.agg(F.count_if("ml_flagged").alias("flagged"), F.count_if(F.col("ml_flagged") & span).alias("masked"), F.count_if(F.col("ml_flagged") & ~span).alias("review"), F.count_if(F.col("ml_flagged") & (F.size(truth) == 0)).alias("false_alarms"))
