"""Weighted terms (tf-idf) beside flags of a text, and models over both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .evaluate import rates
from .normalize import CONTEXTS, context_type

#: A term: a run of two or more letters, digits and underscores, lower-cased.
TERM = r"[\p{L}\p{N}_]{2,}"
FLAGS = ("is_high_entropy", "has_special_chars", "token_count", "has_base64_like", "has_hex_like", "context_encoded")
#: Contexts by the number that encodes them.
ORDER = tuple(sorted((*CONTEXTS, "mixed", "natural_language")))


def add_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds six numbers of a text (null: empty): FLAGS."""
    t = F.coalesce(F.col(text), F.lit(""))
    chars = F.size(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != "")))
    n = F.size(F.filter(F.split(t, f"{X._SPACE}+"), lambda w: w != ""))
    context = F.array_position(F.array(*map(F.lit, ORDER)), context_type(t)) - 1
    values = (F.coalesce(F.try_divide(chars, F.length(t)), F.lit(0.0)) > 0.7, F.regexp_replace(t, f"{X._SPACE}", "").rlike("[^a-zA-Z0-9]"), n, t.rlike("[A-Za-z0-9+/]{20,}={0,2}"), t.rlike(r"(?U)\b[0-9a-fA-F]{10,}\b"), context)
    return df.withColumns({k: v.cast("double") for k, v in zip(FLAGS, values, strict=True)})


def vocabulary(df: DataFrame, text: str = "text", size: int = 1000) -> DataFrame:
    """term, n_rows, n, idf of the ``size`` most frequent terms over all rows, ties by term: at most ``size`` rows.

    A row gives each of its terms once and then all occurrences, both counted by term alone: a task holds the different
    terms of its rows, whatever the number of rows, and hands on each once.
    """
    rows = df.select(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)).alias("t"))
    both = rows.select(F.posexplode(F.array(F.array_distinct("t"), "t")).alias("_all", "terms"))
    counts = both.select("_all", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("_all") == 0).alias("n_rows"), F.count_if(F.col("_all") == 1).alias("n"))
    top = counts.orderBy(F.desc("n"), "term").limit(size)
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return top.crossJoin(F.broadcast(total)).select("term", "n_rows", "n", (F.log((1 + F.col("_total")) / (1 + F.col("n_rows"))) + 1).alias("idf"))


def fit(df: DataFrame, text: str = "text", size: int = 1000):
    """A pipeline that adds tfidf, a sparse vector of length one by term, to rows with a text; ``terms_of`` names its places."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer, SQLTransformer
    from pyspark.ml.linalg import Vectors

    found = vocabulary(df, text, size).orderBy("term").collect() or [None]
    names, idf = ([r.term for r in found], [r.idf for r in found]) if found[0] else ([""], [0.0])
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, coalesce(`{text}`, '') AS _text FROM __THIS__"), RegexTokenizer(inputCol="_text", outputCol="_terms", pattern=TERM, gaps=False),
        CountVectorizerModel.from_vocabulary(names, inputCol="_terms", outputCol="_tf"), ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_w"), Normalizer(inputCol="_w", outputCol="tfidf"),
    ])


def transform(model, df: DataFrame) -> DataFrame:
    """df with tfidf."""
    return model.transform(df).select(*df.columns, "tfidf")


def terms_of(model) -> list[str]:
    """The terms by place in the vectors."""
    return model.stages[2].vocabulary


def weights(model, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, term, weight of the terms a row has."""
    from pyspark.ml.functions import vector_to_array

    each = transform(model, df).select(*keys, F.posexplode(vector_to_array("tfidf")).alias("_i", "weight")).where("weight <> 0")
    return each.select(*keys, F.element_at(F.expr(X.array_of(tuple(terms_of(model)))), F.col("_i") + 1).alias("term"), "weight")


def assembled(model, df: DataFrame, text: str = "text") -> DataFrame:
    """df with x: the weights of the terms and then the flags."""
    from pyspark.ml.feature import VectorAssembler

    out = VectorAssembler(inputCols=["tfidf", *FLAGS], outputCol="x").transform(add_flags(transform(model, df), text))
    return out.select(*df.columns, "x")


def compared(train: DataFrame, test: DataFrame, text: str = "text", label: str = "label", size: int = 1000, seed: int = 7) -> DataFrame:
    """kind, n, accuracy, tp, fp, fn, precision, recall, f1 on test of a logistic regression, a forest and a linear support vector machine.

    Terms and weights are those of train.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier

    from ..sources.staging import staged

    model = fit(train, text, size)
    a, b = (staged(assembled(model, df, text).select(F.col(label).cast("double").alias("label"), "x"), "terms") for df in (train, test))
    kinds = {"lr": LogisticRegression(featuresCol="x"), "rf": RandomForestClassifier(featuresCol="x", numTrees=100, seed=seed), "svm": LinearSVC(featuresCol="x")}
    out = None
    for kind, estimator in kinds.items():
        p, t = F.col("prediction") == 1, F.col("label") == 1
        one = estimator.fit(a).transform(b).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
        one = one.select(F.lit(kind).alias("kind"), "*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))
        out = one if out is None else out.unionByName(one)
    return out
