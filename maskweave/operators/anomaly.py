"""The second layer: features of a text, a gate of structural evidence, suspicious spans, a model.

The model is any fitted Spark ML pipeline over the features' vector (``train`` fits gradient-boosted
trees). It is applied to rows where the first layer masked nothing, and acts only where the gate agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .evaluate import rates
from .mask import PLANNED, is_masked
from .signature import folded_sql

THRESHOLD = 0.75
# The features in their order, and the shapes of suspicious spans.
FEATURES = ("mean_token_entropy", "max_token_entropy", "high_entropy_ratio", "text_length", "token_count", "long_token_ratio", "avg_token_length", "n_digit_runs", "n_special_chars", "n_at_symbols", "n_slashes", "n_equals", "has_base64_pattern", "has_hex_run", "has_bearer_keyword", "has_akia_prefix", "has_sk_prefix")
SPANS = (r"(?U)\bsk-[A-Za-z0-9]{6,}\b", r"(?U)\bAKIA[A-Za-z0-9]{6,}\b", r"[A-Za-z0-9+/]{20,}={0,2}", r"[0-9a-fA-F]{12,}", r"(?U)\b[A-Za-z0-9+/_\-]{16,}\b")
NAMED, SK = r"(?iU)\b(token|key|secret|password|bearer|jwt|api)\b", r"(?U)\bsk-[A-Za-z0-9]"
# Fixed value: the record of a flag without a span.
NO_SPAN = "(whole-prompt signal — no specific span located; see instructions)"


def entropy(t: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    n = F.length(t)
    share = lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n
    chars = F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
    return F.when(n == 0, 0.0).otherwise(-F.aggregate(chars, F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c))))


def add_features(df: DataFrame, text: str = "normalized") -> DataFrame:
    """Adds features, a struct of 17 numbers."""
    t = F.col(text)
    df = df.withColumn("_tok", F.filter(F.split(t, f"{X._SPACE}+"), lambda w: w != ""))
    df = df.withColumn("_ent", F.transform("_tok", entropy))
    n = F.size("_tok")
    many = F.greatest(n, F.lit(1))
    count = lambda s: F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    flag = lambda p: t.rlike(p).cast("int")
    values = (
        total("_ent") / many, F.coalesce(F.array_max("_ent"), F.lit(0.0)), F.size(F.filter("_ent", lambda e: e > 3.5)) / many, F.length(t), n,
        F.size(F.filter("_tok", lambda w: F.length(w) > 15)) / many, total(F.transform("_tok", lambda w: F.length(w).cast("double"))) / many,
        F.size(F.regexp_extract_all(t, F.lit(r"(?U)\d{6,}"), F.lit(0))), F.length(F.regexp_replace(F.regexp_replace(t, f"{X._SPACE}", ""), "[a-zA-Z0-9]", "")),
        count("@"), count("/"), count("="), flag("[A-Za-z0-9+/]{20,}={0,2}"), flag("[0-9a-fA-F]{12,}"), flag(NAMED),
        F.contains(t, F.lit("AKIA")).cast("int"), flag(SK),
    )
    return df.withColumn("features", F.struct(*[v.cast("double").alias(k) for k, v in zip(FEATURES, values, strict=True)])).drop("_tok", "_ent")


def gate(f: Column) -> Column:
    """Structural evidence in the features."""
    out = (f["high_entropy_ratio"] > 0.3) | (f["long_token_ratio"] > 0.2)
    for k in FEATURES[12:]:
        out = out | (f[k] > 0)
    return out


#: A token of fewer characters has no more than 11 kinds of them, and so less than 3.5 bits.
_LEAST = 12


def opened(t: Column) -> Column:
    """``gate`` of a text, the cheap evidence first: words are split only where there is none, and entropy is that of long words in texts with many."""
    low = folded_sql("t")
    words = "token", "key", "secret", "password", "bearer", "jwt", "api"
    named = f"transform(array({low}), low -> {' OR '.join(f'contains(low, {X.quoted(w)})' for w in words)})[0]"
    run = lambda c, n: f"t RLIKE {X.quoted(f'(?<![{c}])[{c}]{{{n}}}')}"
    flags = ["contains(t, 'AKIA')", f"(contains(t, 'sk-') AND t RLIKE {X.quoted(SK)})", run("0-9a-fA-F", 12), run("A-Za-z0-9+/", 20), f"({named} AND t RLIKE {X.quoted(NAMED)})"]
    # w: all words, the first and the last of which may be empty; long ones are few
    n = "greatest(size(w) - cast(w[0] = '' as int) - cast(size(w) > 1 AND w[size(w) - 1] = '' as int), 1)"
    count = f"transform(array(split(t, {X.quoted(X._SPACE + '+')}, -1)), w -> named_struct('n', {n}, 'long', filter(w, v -> length(v) >= {_LEAST})))[0]"
    share = f"size(filter(c.long, v -> length(v) > 15)) / c.n > 0.2 OR size(c.long) / c.n > 0.3 AND size(filter(c.long, v -> {_entropy_sql('v')} > 3.5)) / c.n > 0.3"
    return X.applied(f"t -> {' OR '.join(flags)} OR transform(array({count}), c -> {share})[0]", t)


def _entropy_sql(v: str) -> str:
    """``entropy`` as SQL."""
    share = f"(length({v}) - length(replace({v}, c, ''))) / length({v})"
    return f"-aggregate(array_distinct(filter(split({v}, '', -1), c -> c <> '')), 0.0D, (acc, c) -> acc + {share} * log2({share}))"


def suspicious_spans(t: Column) -> Column:
    """start, end of the shapes' matches of 8 characters and more; overlapping and touching ones are one."""
    each = [F.transform(F.filter(X.find_all(t, p), lambda m: m["end"] - m["start"] >= 8), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for p in SPANS]
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, m: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], m["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (m["start"] <= F.when(F.size(acc) > 0, last["end"])), joined).otherwise(F.concat(acc, F.array(m)))

    found = F.sort_array(F.concat(*each))
    return F.when(F.size(found) > 0, F.aggregate(found, X.empty(kind), step)).otherwise(X.empty(kind))


def vectorised(df: DataFrame) -> DataFrame:
    """Adds the vector column x."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("x", array_to_vector(F.array(*[F.col("features")[k] for k in FEATURES])))


def score(df: DataFrame, model) -> DataFrame:
    """Adds probability of label 1 as anomaly_score."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(vectorised(df))
    return out.withColumn("anomaly_score", vector_to_array("probability")[1]).select(*df.columns, "anomaly_score")


def with_second_layer(df: DataFrame, model) -> DataFrame:
    """Adds _ml: score, fires (the model and the gate agree) and the suspicious spans; such rows may have entities.

    Row-local: whether the first layer masked nothing is known later.
    """
    names = df.columns
    t = F.col("normalized")
    df = score(add_features(df), model)
    fires = F.coalesce((F.col("anomaly_score") >= THRESHOLD) & gate(F.col("features")), F.lit(False))
    df = df.withColumn("_fires", fires)
    spans = F.transform(suspicious_spans(t), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.substring(t, m["start"] + 1, m["end"] - m["start"]).alias("value")))
    ml = F.struct(F.col("anomaly_score").alias("score"), F.col("_fires").alias("fires"), F.when(F.col("_fires"), spans).alias("spans"))
    return df.select(*[c for c in names if c != "_maybe"], (F.col("_maybe") | F.col("_fires")).alias("_maybe"), ml.alias("_ml"))


def safety_net(df: DataFrame) -> DataFrame:
    """Adds ml_flagged, and the second layer's entities to planned where the first masked nothing."""
    points = F.round("_ml.score", 3)

    def entity(value: Column, start: Column, end: Column, action: str, strategy: str, seq: Column) -> Column:
        return F.struct(F.lit("ML_FLAGGED_ANOMALY").alias("entity_type"), value.alias("value"), start.alias("start"), end.alias("end"), F.lit("MEDIUM").alias("sensitivity"), points.alias("score"), F.lit(action).alias("action"), F.lit(strategy).alias("strategy"), seq.alias("seq"), F.lit(None).cast("string").alias("replacement"))

    df = df.withColumn("ml_flagged", F.col("_ml.fires") & ~F.exists("planned", is_masked))
    spans = F.transform("_ml.spans", lambda m, i: entity(m["value"], m["start"], m["end"], "ml_flagged_mask", "tokenize", F.size("planned") + i)).cast(PLANNED)
    review = F.array(entity(F.lit(NO_SPAN), F.lit(0), F.lit(0), "review", "ml_anomaly_flagged_no_span", F.size("planned"))).cast(PLANNED)
    more = F.when(~F.col("ml_flagged"), X.empty(PLANNED)).when(F.size("_ml.spans") > 0, spans).otherwise(review)
    return df.withColumn("planned", F.concat("planned", more)).drop("_ml")


# Types that make a prompt sensitive; those of contact, financial and infrastructure data alone do not.
SENSITIVE = (
    "NIC_OLD", "NIC_NEW", "PASSPORT", "DRIVING_LICENSE", "TAX_ID", "FULL_NAME", "DATE_OF_BIRTH", "HOME_ADDRESS", "PAN", "CVV", "CARD_EXPIRY",
    "API_KEY_OPENAI", "API_KEY_GENERIC", "JWT_TOKEN", "PASSWORD", "PRIVATE_KEY", "JWT_IN_LOG", "AWS_ACCESS_KEY", "AWS_SECRET_KEY", "S3_BUCKET_REF",
)


def label_rule(entities: str = "entities") -> Column:
    """1.0 if any of the types is sensitive, else 0.0."""
    return F.when(F.arrays_overlap(entities, F.array(*map(F.lit, SENSITIVE))), 1.0).otherwise(0.0)


def split(df: DataFrame, label: str = "label", shares: tuple[float, float] = (0.6, 0.2), seed: int = 7, key: str = "normalized", buckets: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test rows, with these shares of each label (the test has the rest).

    The rows of a label are ranked by a hash of the key, in buckets of the hash, so no label is one task's:
    the shares hold up to a row a bucket.
    """
    turn = F.xxhash64(key, F.lit(seed))
    by = Window.partitionBy(label, F.pmod(turn, F.lit(buckets)))
    place = (F.row_number().over(by.orderBy(turn, key)) - 0.5) / F.count(F.lit(1)).over(by)
    parted = df.withColumn("_place", place)
    a, b = shares[0], shares[0] + shares[1]
    return tuple(parted.where(c).drop("_place") for c in (F.col("_place") <= a, (F.col("_place") > a) & (F.col("_place") <= b), F.col("_place") > b))


def estimator(kind: str = "gbt", label: str = "label", seed: int = 7):
    """A pipeline over the vector x: standardised features and gradient-boosted trees (gbt), logistic regression (lr), a forest (rf), a network (mlp) or a support vector machine with a Gaussian kernel (svm).

    The kernel is that of random Fourier features; the machine's margin becomes a probability by a logistic curve fitted on the same rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler

    from .fourier import FourierFeatures

    n = len(FEATURES)
    last = {
        "gbt": lambda: GBTClassifier(featuresCol="z", labelCol=label, maxDepth=4, maxIter=100, stepSize=0.1, seed=seed),
        "lr": lambda: LogisticRegression(featuresCol="z", labelCol=label),
        "rf": lambda: RandomForestClassifier(featuresCol="z", labelCol=label, numTrees=100, seed=seed),
        "mlp": lambda: MultilayerPerceptronClassifier(featuresCol="z", labelCol=label, layers=[n, 64, 32, 2], seed=seed),
        "svm": lambda: [FourierFeatures(inputCol="z", outputCol="r", width=n, features=256, gamma=1 / n, seed=seed), LinearSVC(featuresCol="r", labelCol=label, regParam=1e-3, rawPredictionCol="margin", predictionCol="_side"), LogisticRegression(featuresCol="margin", labelCol=label)],
    }[kind]()
    return Pipeline(stages=[StandardScaler(inputCol="x", outputCol="z", withMean=True), *(last if isinstance(last, list) else [last])])


def train(df: DataFrame, label: str = "label", seed: int = 7, kind: str = "gbt"):
    """A fitted model; df has features and a label of 0 or 1."""
    return estimator(kind, label, seed).fit(vectorised(df))


def report(model, df: DataFrame, label: str = "label") -> DataFrame:
    """n, accuracy, precision, recall, f1, auc of the model on rows with features and a label: one row."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    out = model.transform(vectorised(df))
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability").evaluate(out)
    tp, fp, fn = (F.count_if(c) for c in ((F.col("prediction") == 1) & (F.col(label) == 1), (F.col("prediction") == 1) & (F.col(label) == 0), (F.col("prediction") == 0) & (F.col(label) == 1)))
    sums = out.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return sums.select("n", "accuracy", *rates(F.col("tp"), F.col("fp"), F.col("fn")), F.lit(auc).alias("auc"))


def folded(df: DataFrame, label: str = "label", folds: int = 5, seed: int = 7, key: str = "normalized", buckets: int = 8) -> DataFrame:
    """Adds _fold: the rows of each label are dealt out in turn, in the order of a hash of the key.

    As in ``split``, a label is ranked in buckets of the hash, each starting with another fold, so a fold has
    its share of every label up to a row a bucket.
    """
    turn = F.xxhash64(key, F.lit(seed))
    bucket = F.pmod(turn, F.lit(buckets))
    place = F.row_number().over(Window.partitionBy(label, bucket).orderBy(turn, key))
    return df.withColumn("_fold", F.pmod(place + bucket, F.lit(folds)).cast("int"))


def cross_validated(df: DataFrame, label: str = "label", folds: int = 5, seed: int = 7, kind: str = "gbt") -> list[float]:
    """The area under the curve of each stratified fold's model on the rows left out."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    parts = folded(vectorised(df), label, folds, seed)
    score_ = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability")
    return [score_.evaluate(estimator(kind, label, seed).fit(parts.where(F.col("_fold") != k)).transform(parts.where(F.col("_fold") == k))) for k in range(folds)]


def compared(train_rows: DataFrame, validation: DataFrame, kinds: tuple[str, ...] = ("lr", "rf", "gbt", "mlp", "svm"), label: str = "label") -> DataFrame:
    """kind and report of a model of each kind, the best area under the curve first."""
    out = None
    for kind in kinds:
        one = report(train(train_rows, label, kind=kind), validation, label).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("auc"), "kind")


def retrain(df: DataFrame, probe: DataFrame, path: str, most: float = 0.15, label: str = "label", kind: str = "gbt") -> tuple[bool, DataFrame]:
    """Trains on 60 %, reports on the held-out 20 %, and saves the model to path, with its rate on the benign probe, only if that accepts it."""
    fitting, _, test = split(add_features(df), label)
    model = train(fitting, label, kind=kind)
    rate = probe_rate(model, probe)
    ok = rate is None or rate <= most
    if ok:
        model.write().overwrite().save(path)
        df.sparkSession.createDataFrame([(kind, rate, most)], "kind string, probe_rate double, most double").coalesce(1).write.mode("overwrite").json(f"{path}/probe")
    return ok, report(model, test, label)


def probe_rate(model, probe: DataFrame, text: str = "normalized") -> float | None:
    """The share of a benign probe set that the model alone flags; null without rows."""
    return score(add_features(probe, text), model).agg(F.avg((F.col("anomaly_score") >= THRESHOLD).cast("double"))).first()[0]


def saved(spark: SparkSession, path: str, most: float | None = None):
    """The model that ``retrain`` left at path, for ``protect(anomaly_model=...)``; None where there is none, and the layer is off.

    With most, a model that flagged more than that of its probe isn't taken either. A model that is there
    but can't be read is an error.
    """
    from pyspark.ml import PipelineModel

    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    if most is not None:
        rate = spark.read.schema("probe_rate double").json(f"{path}/probe").first()
        if rate is None or (rate.probe_rate or 0.0) > most:
            return None
    return PipelineModel.load(path)


def accepted(model, probe: DataFrame, most: float = 0.15, text: str = "normalized") -> bool:
    """Whether the model alone flags at most this share of a benign probe set."""
    rate = probe_rate(model, probe, text)
    return rate is None or rate <= most
