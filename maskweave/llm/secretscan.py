"""Secret scans by character Markov models (operator 10), in DataFrame functions alone.

Base secrets (assign, access, hex) are found by pattern. Any other token of ``SHORTEST`` signs
or more is scored by two first-order character models, one of random strings and one of ordinary
identifiers; it is a span of kind ``markov`` if its log-likelihood ratio a sign is over
``THRESHOLD``, and its whole ratio is that of ``MIN_LENGTH`` such signs at least, so short tokens need
a higher one (and digits alone under ``MIN_LENGTH`` signs are numbers). A token with slashes or dots inside (standard Base64, paths) is scored whole,
where half of ``THRESHOLD`` a sign is enough if the whole ratio is reached; where the whole is ordinary, its parts are scored one by one. Both models are counts of pairs of signs with add-one smoothing, trained from
labelled samples: random strings over four alphabets and the corpus's own base secrets against
identifiers made of common words and all long words of letters in the corpus. Counts cover every
text; they meet as partial sums of at most one row for each pair of signs, a table of fixed size.

Everything is row-local but for those sums, and no Python runs on the executors.

Defined cases: a null text has no spans; null ids and repeated rows are kept; an empty table gives
an empty result and models of the made samples alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"  # of maximal runs, those of 32 signs
_SIGNS = "A-Za-z0-9_+=-"
MIN_LENGTH = 20
SHORTEST = 12
TOKEN = f"(?<![{_SIGNS}])[{_SIGNS}]{{{SHORTEST},}}"
WHOLE = f"(?<![{_SIGNS}])[{_SIGNS}][/.{_SIGNS}]{{{SHORTEST - 2},}}[{_SIGNS}]"
WORD = "(?<![A-Za-z])[A-Za-z]{12,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+=-/."
THRESHOLD = 0.6
#: Words of ordinary identifiers.
COMMON = "get set user name value config count index list item file path data type key id time date start end max min size limit cache queue event handler request response service manager controller factory builder parser reader writer client server session token password secret message error result status update delete create insert select order table column field number string buffer stream thread process system default global local public private module package test".split()

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def find_all(t: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """start, kind, end and value of all matches, in code points: matches and the gaps between them alternate."""
    matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    values = matches if value_group == 0 else F.regexp_extract_all(t, F.lit(pattern), F.lit(value_group))
    parts = F.zip_with(F.zip_with(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), values, lambda x, v: F.struct(x["g"].alias("g"), x["m"].alias("m"), v.alias("v")))
    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + x["m"]
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(_SPAN)), F.array(one)).alias("out"))

    return F.coalesce(F.aggregate(parts, begin, step, lambda acc: acc["out"]), F.array().cast(_SPAN))


def none() -> Column:
    return F.array().cast(_SPAN)


def base_spans(t: Column) -> Column:
    """Base secrets of a text that isn't null; guards keep the full patterns off most texts."""
    assign = F.filter(find_all(t, ASSIGN, 0, 2), lambda m: F.length(m["value"]) >= 8)
    access = F.filter(find_all(t, ACCESS, 1), lambda m: F.length(m["value"]) >= 16)
    return F.concat(
        F.when(t.rlike("[:=]") & t.rlike("(?i)password|passwd|secret|token|api_?key"), assign).otherwise(none()),
        F.when(F.contains(t, F.lit("AKIA")), access).otherwise(none()),
        F.when(t.rlike(HEX), find_all(t, HEX, 2)).otherwise(none()),
    )


def _pairs(tokens: DataFrame, label: str) -> DataFrame:
    """pair, n: pairs of signs of the column token."""
    pairs = tokens.where("length(token) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(label))


def random_strings(spark: SparkSession, n: int = 3000, length: int = 40) -> DataFrame:
    """token: strings over hexadecimal, alphanumeric, URL-safe and standard Base64 signs, the same in every run."""
    pick = F.element_at(F.array(F.lit("0123456789abcdef"), F.lit(ALPHABET[:62]), F.lit(ALPHABET[:63] + "-"), F.lit(ALPHABET[:62] + "+/")), (F.col("id") % 4 + 1).cast("int"))
    sign = lambda i: F.substring(F.col("alphabet"), (F.pmod(F.xxhash64("id", i), F.length("alphabet")) + 1).cast("int"), F.lit(1))
    return spark.range(n).withColumn("alphabet", pick).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), sign), "").alias("token"))


def identifiers(spark: SparkSession, n: int = 3000) -> DataFrame:
    """token: identifiers of four common words, in snake, kebab, joined and camel case, and as paths and dotted names."""
    words = F.array(*map(F.lit, COMMON))
    parts = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", i), F.lit(len(COMMON))) + 1).cast("int")))
    camel = F.array_join(F.transform("parts", F.initcap), "")
    kind = F.col("id") % 6
    case = F.when(kind == 0, F.array_join("parts", "_")).when(kind == 1, F.array_join("parts", "-")).when(kind == 2, F.array_join("parts", "")).when(kind == 3, F.array_join("parts", "/")).when(kind == 4, F.array_join("parts", ".")).otherwise(camel)
    return spark.range(n).withColumn("parts", parts).select(case.alias("token"))


def train(texts: DataFrame) -> list[list[float]]:
    """Log-likelihood ratios (random over ordinary) of each pair of ALPHABET's signs; texts: a column t without nulls."""
    spark = texts.sparkSession
    secrets = texts.select(F.explode(base_spans(F.col("t"))).alias("m")).select(F.col("m")["value"].alias("token"))
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("token"))
    # a word counts by the texts' own frequency, but not more than the made samples for all its copies
    rows = _pairs(random_strings(spark), "random").union(_pairs(secrets, "secret")).union(_pairs(identifiers(spark), "made")).union(_pairs(words, "word")).collect()  # a row for each pair and sample
    at = {c: i for i, c in enumerate(ALPHABET)}
    size = len(ALPHABET)
    sums = {k: [[0.0] * size for _ in range(size)] for k in ("random", "secret", "made", "word")}
    for r in rows:
        if len(r["pair"]) == 2 and r["pair"][0] in at and r["pair"][1] in at:
            sums[r["label"]][at[r["pair"][0]]][at[r["pair"][1]]] += r["n"]
    model = {}
    for name, (made, seen) in {"random": ("random", "secret"), "ordinary": ("made", "word")}.items():
        scale = sum(map(sum, sums[made])) / max(sum(map(sum, sums[seen])), 1.0)
        both = [[a + scale * b for a, b in zip(x, y, strict=True)] for x, y in zip(sums[made], sums[seen], strict=True)]
        model[name] = [[math.log((n + 1) / (sum(row) + size)) for n in row] for row in both]
    # slashes and dots say nothing by themselves: Base64 has few, paths many; the signs between them tell
    return [[0.0 if {c, d} & {"/", "."} else a - b for d, a, b in zip(ALPHABET, x, y, strict=True)] for c, x, y in zip(ALPHABET, model["random"], model["ordinary"], strict=True)]


def ratio(token: Column, table: Column) -> Column:
    """The token's mean log-likelihood ratio a pair of signs."""
    size = len(ALPHABET)
    index = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, (index(i) - 1) * size + index(i + 1)))
    return total / (F.length(token) - 1)


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans: array of start, kind (index of KINDS), end, value; sorted by start and kind."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    table = F.array(*[F.lit(v) for row in train(texts.select("t")) for v in row])
    t = F.col("t")
    whole = F.filter(find_all(t, WHOLE, 3), lambda m: m["value"].rlike("[/.]"))
    rows = texts.select("doc_id", base_spans(t).alias("base"), F.when(t.rlike(WHOLE), whole).otherwise(none()).alias("wholes"), F.when(t.rlike(TOKEN), find_all(t, TOKEN, 3)).otherwise(none()).alias("tokens"))
    apart = lambda m, spans: ~F.exists(spans, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    enough = lambda v, least: (v.rlike("[^0-9]") | (F.length(v) >= MIN_LENGTH)) & (ratio(v, table) * F.least((F.length(v) - 1) / (MIN_LENGTH - 1), F.lit(threshold / least)) > threshold)
    found = lambda name, least: F.when(F.size(name) > 0, F.filter(name, lambda m: apart(m, "base") & enough(m["value"], least))).otherwise(none())
    rows = rows.select("doc_id", "base", found("wholes", threshold / 2).alias("wholes"), found("tokens", threshold).alias("tokens"))
    random = F.concat("wholes", F.filter("tokens", lambda m: apart(m, "wholes")))
    return rows.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), m["kind"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")
    base = F.filter("spans", lambda m: m["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda m: m["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
