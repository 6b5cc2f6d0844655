"""Queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dedup, htmltext, jaccard, packing, phrases, pii, quality, resample, secretscan, simhash, tokenio, toxicity
from .util import table


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", pii.digest(F.col("spans")).alias("d")).select("doc_id", "d.*")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenio.round_trip(table(spark, sf_dir, "documents"))


def op8_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_spans(table(spark, sf_dir, "documents"))


def op10_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.detect(table(spark, sf_dir, "documents")))


def op11_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_phrase_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Operator 4: the counts, the hosts' shrunken rates and both verdicts. A row number stands for a row: ids may repeat.
_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
again AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, CAST(count(DISTINCT i + k) AS BIGINT) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY r),
f AS (SELECT w.r, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols * 4 > greatest(n_words, 1) OR n_dup_lines * 20 > greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1) OR word_chars < 2 * greatest(n_words, 1) AS soft FROM f),
h AS (SELECT host, count(*) AS n, CAST(count_if(base_failed OR soft) AS DOUBLE) AS k FROM b GROUP BY host),
m AS (SELECT least(greatest(avg(k / n), 1e-4), 1 - 1e-4) AS mean, coalesce(var_samp(k / n), 0.0) AS var, avg(1.0 / n) AS inv FROM h),
z AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-5) - 1, 1.0), 1e4) AS z FROM m),
v AS (SELECT host, CASE WHEN (k + mean * z) / (n + z) >= 0.95 THEN 2 WHEN (k + mean * z) / (n + z) >= 0.5 THEN 1 ELSE 0 END AS host_verdict FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_verdict < CASE WHEN soft THEN 1 ELSE 2 END AS kept, host_verdict
FROM b JOIN v USING (host)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Operator 12: all grams are counted, then cut, compared with those that hold them, and ranked.
_PHRASES = rf"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS x FROM f WHERE k > 1 AND f >= 30),
u AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(x[1:cut], ' ') AS pl, array_to_string(x[cut + 1:], ' ') AS pr FROM (SELECT lang, phrase, f AS a, x, unnest(range(1, k)) AS cut FROM c)),
e AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 30),
s AS (SELECT u.lang, u.phrase, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS score FROM u
  JOIN e l ON l.lang = u.lang AND l.phrase = u.pl JOIN e r ON r.lang = u.lang AND r.phrase = u.pr),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, array_to_string(x[i:i + m - 1], ' ') AS phrase, max(f) AS most FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY 1, 2),
k AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN n USING (lang) QUALIFY rank <= 2000
"""

#: Operator 13: CRC-32 of each distinct word by the table of its polynomial, gains of buckets, keys and ranks.
_RESAMPLE = rf"""
WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS text FROM documents),
w AS (SELECT r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
q AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM w UNION SELECT w FROM q)),
y AS (SELECT w, list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))) AS y FROM x),
b AS (SELECT w, xor(list_reduce(y, lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 10000 AS b FROM y, t),
s AS (SELECT b, count(*) AS s FROM w JOIN b USING (w) GROUP BY b), q2 AS (SELECT b, count(*) AS t FROM q JOIN b USING (w) GROUP BY b),
z AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM w) AS s, (SELECT CAST(count(*) AS DOUBLE) FROM q) AS t),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(q2.t, 0) + 1.0) * (z.s + 10000.0) / ((s.s + 1.0) * (z.t + 10000.0)))) AS BIGINT) AS g FROM s LEFT JOIN q2 USING (b), z),
f AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM w JOIN b USING (w) JOIN g USING (b) GROUP BY r),
v AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight, CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM d LEFT JOIN f USING (r)),
k AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM v),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS o, count(*) FILTER (n_features >= 20) OVER () AS able FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN o <= 10 * able // 100 THEN o END AS rank FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_host_quality": _QUALITY, "op12_phrase_levels": _PHRASES, "op13_target_resampling": _RESAMPLE}
