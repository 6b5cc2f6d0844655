"""Session tokens in batch: first appearances ranked by session and by type.

A value keeps its first token in a session, whatever its later types. Tokens of a type are numbered
by first appearance: prompts in order, within a prompt in order of masking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.staging import staged

MAP = ("session", "value", "token", "entity_type", "first_seen", "last_seen", "number")


def label_of(kind: Column) -> Column:
    return F.when(kind == "ML_FLAGGED_ANOMALY", "ML_SECRET").otherwise(F.upper(F.left(F.regexp_replace(kind, "_", ""), F.lit(10))))


def occurrences(df: DataFrame, session: str, order: str, planned: str = "planned") -> DataFrame:
    """session, prompt, seq, value, entity_type of everything to tokenise."""
    wanted = F.filter(planned, lambda p: p["strategy"] == "tokenize")
    rows = df.select(F.col(session).alias("session"), F.col(order).alias("prompt"), F.explode(wanted).alias("p"))
    return rows.select("session", "prompt", "p.seq", "p.value", "p.entity_type")


def token_map(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """session, value, token, entity_type, first_seen, last_seen, number of the values that known (an earlier map) lacks.

    The first appearance of each value is a partial aggregate, so a value that fills a session is
    one row before anything is ranked. A session may hold most of the values: they are dealt out in
    ranges of their order, counted there, and numbered from the counts of the ranges before, so no
    session is one task's. Sessions compare null-safe.
    """
    spark = found.sparkSession
    first = found.groupBy("session", "value").agg(F.min(F.struct("prompt", "seq", "entity_type")).alias("f"), F.max("prompt").alias("last_seen"))
    if known is not None:
        old = known.select(F.col("session").alias("_s"), F.col("value").alias("_v"))
        first = first.join(old, first["session"].eqNullSafe(old["_s"]) & (first["value"] == old["_v"]), "left_anti")
    first = first.select("session", "value", F.col("f.entity_type").alias("entity_type"), F.col("f.prompt").alias("first_seen"), F.col("f.seq").alias("seq"), "last_seen")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(first.repartitionByRange(n, "session", "entity_type", "first_seen", "seq").withColumn("_part", F.spark_partition_id()), "tokens")
    counts = dealt.groupBy("session", "entity_type", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("session", "entity_type").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("session").alias("_s"), F.col("entity_type").alias("_t"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    if known is not None:
        top = known.groupBy("session", "entity_type").agg(F.max("number").alias("_top")).select(F.col("session").alias("_ks"), F.col("entity_type").alias("_kt"), "_top")
        bases = bases.join(top, bases["_s"].eqNullSafe(top["_ks"]) & (bases["_t"] == top["_kt"]), "left").select("_s", "_t", "_p", (F.col("_base") + F.coalesce("_top", F.lit(0))).alias("_base"))
    within = F.row_number().over(Window.partitionBy("session", "entity_type", "_part").orderBy("first_seen", "seq"))
    out = dealt.withColumn("_rank", within).join(bases, dealt["session"].eqNullSafe(bases["_s"]) & (dealt["entity_type"] == bases["_t"]) & (dealt["_part"] == bases["_p"]))
    number = (F.col("_rank") + F.col("_base")).cast("long")
    token = F.concat(F.lit("<"), label_of(F.col("entity_type")), F.lit("_"), number.cast("string"), F.lit(">"))
    return out.select("session", "value", token.alias("token"), "entity_type", "first_seen", "last_seen", number.alias("number"))


def fill(plans: DataFrame, tokens: DataFrame, planned: str = "planned") -> DataFrame:
    """plans (_row, _session, planned) with the token of every value to tokenise as its replacement."""
    wanted = F.array_distinct(F.transform(F.filter(planned, lambda p: p["strategy"] == "tokenize"), lambda p: p["value"]))
    keys = plans.select("_row", "_session", F.explode(wanted).alias("_value"))
    pairs = keys.join(tokens, keys["_session"].eqNullSafe(tokens["session"]) & (keys["_value"] == tokens["value"]))
    maps = pairs.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("value", "token"))).alias("_tokens"))
    put = F.transform(planned, lambda p: p.withField("replacement", F.when(p["strategy"] == "tokenize", F.element_at("_tokens", p["value"])).otherwise(p["replacement"])))
    return plans.join(maps, "_row", "left").withColumn(planned, put).drop("_tokens")


def unmask(masked: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of (session, token) with the original value; for use where the map may be read. Sessions compare null-safe."""
    map_ = tokens.select(F.col("session").alias("_s"), F.col("token").alias("_t"), F.col("value").alias("original"))
    return masked.join(map_, masked["session"].eqNullSafe(map_["_s"]) & (masked["token"] == map_["_t"]), "left").drop("_s", "_t")


#: Tokens as they stand in a text: a label without angle brackets or blanks, and a number.
TOKEN = r"<[^<>\s]+_[0-9]+>"


def restore(df: DataFrame, text: str, tokens: DataFrame, session: str | None = None, to: str = "restored") -> DataFrame:
    """df with the tokens of a text, such as a model's answer, replaced by their session's values.

    For use where the map may be read. A token is read whole, so none is found inside another; one that the session's
    map lacks stays as it is, also where another session has it. Sessions compare null-safe; without a session column, ``tokens``
    is of one session. A value that looks like a token is not looked up again. A null text stays null. Texts are exchanged
    once, by row; what the map sees is each row's distinct tokens.
    """
    id_, own = "_restore_row", [f"`{c}`" for c in df.columns]
    t = f"coalesce(`{text}`, '')"
    rows = staged(df.selectExpr("*", f"monotonically_increasing_id() AS {id_}"), "answers")
    whose = f"`{session}`" if session else "cast(NULL AS string)"
    wanted = rows.selectExpr(id_, f"{whose} AS _s", f"explode(array_distinct(regexp_extract_all({t}, {X.quoted(TOKEN)}, 0))) AS _t")
    known = tokens.selectExpr("session AS _ks" if session else "cast(NULL AS string) AS _ks", "token AS _kt", "value AS _kv")
    pairs = wanted.join(known, wanted["_s"].eqNullSafe(known["_ks"]) & (wanted["_t"] == known["_kt"]))
    maps = pairs.groupBy(id_).agg(F.expr("map_from_entries(collect_list(struct(_t, _kv))) AS _values"))
    found = f"regexp_extract_all({t}, {X.quoted(TOKEN)}, 0)"
    put = f"array_join(zip_with(split({t}, {X.quoted(TOKEN)}, -1), transform({found}, t -> coalesce(try_element_at(_values, t), t)), (g, t) -> concat(g, coalesce(t, ''))), '')"
    return rows.join(maps, id_, "left").selectExpr(*own, f"CASE WHEN _values IS NULL THEN `{text}` ELSE {put} END AS `{to}`")


def summary(tokens: DataFrame) -> DataFrame:
    """A line for each token of a session."""
    return tokens.select("session", F.concat_ws(" ", F.col("token"), F.lit("->"), F.col("entity_type"), F.concat(F.lit("(first prompt "), F.col("first_seen").cast("string"), F.lit(", last "), F.col("last_seen").cast("string"), F.lit(")"))).alias("line"))
