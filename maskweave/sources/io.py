"""Sources and sinks of prompts, datasets and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import RuleSet
from .staging import staged

DATASET = "id string, category string, type string, prompt string, entities array<string>, note string"


def text_column(spark: SparkSession, texts: list[str], session: str = "session") -> DataFrame:
    """session, prompt_no, text from a few given texts."""
    return spark.createDataFrame([(session, i + 1, t) for i, t in enumerate(texts)], "session string, prompt_no int, text string")


def line_file(spark: SparkSession, path: str) -> DataFrame:
    """session (the file), prompt_no, text: every line that isn't blank, stripped, numbered in the file's order.

    A large file is read in splits, each in its own order; a line's number is its place in its split after the
    counts of the splits before, which are a row each. Numbers are staged with the lines, so that a split
    that is read again can't change them.
    """
    read = spark.read.text(path).selectExpr("_metadata.file_path AS session", "_metadata.file_block_start AS _block", "monotonically_increasing_id() AS _i", r"regexp_replace(value, '^\\s+|\\s+$', '') AS text")
    kept = staged(read.where("text <> ''"), "lines")
    counts = kept.groupBy("session", "_block").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.selectExpr("session", "_block", "sum(_n) OVER (PARTITION BY session ORDER BY _block) - _n AS _base")
    return kept.join(bases, ["session", "_block"]).selectExpr("session", "cast(row_number() OVER (PARTITION BY session, _block ORDER BY _i) + _base AS int) AS prompt_no", "text")


def json_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of labelled prompts."""
    return spark.read.schema(DATASET).json(path, multiLine=True)


def write_results_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_dataset(rows: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines, or CSV with the entities joined by pipes."""
    if kind == "csv":
        write_results_csv(rows.withColumn("entities", F.array_join("entities", "|")), path)
    else:
        rows.write.mode("overwrite").json(path)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One JSON value a row."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("json"))


# Fixed value: what the response names as the pattern of the second layer.
SECOND_LAYER = "ML classifier + suspicious-span rule"


def response(df: DataFrame, text: str = "text", rules: RuleSet | None = None, available: bool = False) -> DataFrame:
    """The detection response of protected rows as JSON in column json: entities of both layers in order of start.

    available: whether a second layer's model was given to ``protect``.
    """
    rules = rules or RuleSet()
    table = [*rules.ordered(), *rules.named]
    patterns = {r.type: r.pattern for r in reversed(rules.rules)}

    def pattern(e: Column) -> Column:
        of_rule = F.element_at(F.array(*[F.lit(r.pattern) for r in table]), e["rule"] + 1)
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in patterns.items() for x in kv]), e["entity_type"]), of_rule) if patterns else of_rule

    kinds = ("entity_type", "value", "replacement", "start", "end", "category", "sensitivity", "matched_pattern", "score", "score_breakdown", "confidence_level", "action", "layer")

    def one(values: dict[str, Column]) -> Column:
        return F.struct(*[values[k].alias(k) for k in kinds])

    def first(e: Column) -> Column:
        return one({"entity_type": e["entity_type"], "value": e["value"], "replacement": F.lit(None).cast("string"), "start": e["start"], "end": e["end"], "category": e["category"], "sensitivity": e["sensitivity"], "matched_pattern": pattern(e), "score": e["score"], "score_breakdown": e["breakdown"], "confidence_level": e["level"], "action": e["action"], "layer": F.lit(1)})

    def second(m: Column) -> Column:
        none = F.lit(None).cast(df.schema["resolved"].dataType.elementType["breakdown"].dataType)
        sure = F.concat(F.round(m["score"] * 100).cast("int").cast("string"), F.lit("% ML confidence"))
        return one({"entity_type": m["entity_type"], "value": m["original"], "replacement": m["replacement"], "start": m["start"], "end": m["end"], "category": F.lit("ML"), "sensitivity": m["sensitivity"], "matched_pattern": F.lit(SECOND_LAYER), "score": m["score"], "score_breakdown": none, "confidence_level": sure, "action": m["action"], "layer": F.lit(2)})

    mine = F.filter("masked", lambda m: m["entity_type"] == "ML_FLAGGED_ANOMALY")
    review = F.filter("skipped", lambda m: m["entity_type"] == "ML_FLAGGED_ANOMALY")
    both = F.concat(F.transform("resolved", first), F.transform(mine, second))
    turned = F.transform(F.array_sort(F.transform(both, lambda e, i: F.struct(e["start"].alias("s"), i.alias("i"), e.alias("e"))), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["i"] - b["i"])), lambda x: x["e"])
    flag = F.coalesce(F.try_element_at(F.transform(mine, lambda m: m["score"]), F.lit(1)), F.try_element_at(F.transform(review, lambda m: m["score"]), F.lit(1)))
    net = F.struct(F.lit(available).alias("available"), flag.isNotNull().alias("flagged"), (F.size(mine) > 0).alias("masked"), flag.alias("score"))
    body = F.struct(F.col(text).alias("original"), F.when(F.col("normalized") != F.col(text), F.col("normalized")).alias("normalized"), F.col("despaced"), "transformations", "context_type", "masked_text", "overall_risk", turned.alias("entities"), net.alias("ml_safety_net"))
    return df.withColumn("json", F.to_json(body))
