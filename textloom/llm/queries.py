"""The queries opN_<name> and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ann, decontamination, licenses, line_dedup, packing, quality, simhash, token_counts, toxicity, url_filter
from textloom.llm.common import LOWER, UPPER, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


#: (verdict, host, path) in the order given.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_in(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path, token_counts.new_cache(spark), limit=2048)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


OP6_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
iw AS (SELECT row_number() OVER () AS item, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
ds AS (SELECT DISTINCT rid, doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT rid, doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM dw WHERE len(ws) > 0)),
si AS (SELECT DISTINCT item, item_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT item, item_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM iw WHERE len(ws) > 0)),
n AS (SELECT item, count(*) AS n_item FROM si GROUP BY item),
m AS (SELECT ds.rid, ds.doc_id, si.item, si.item_id, count(*) AS n_shared FROM ds JOIN si USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM m JOIN n USING (item) WHERE n_shared / n_item >= 0.8 - 1e-9
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.coalesce("dice", F.lit(0.0)).alias("dice"), F.coalesce("first_word", F.lit(-1)).alias("first_word"), F.array_join("licenses", ",").alias("licenses"))


_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES))
_BIGRAMS = "list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])"
OP9_SQL = f"""
WITH t AS (SELECT n, name, len(w) AS size, list_distinct({_BIGRAMS}) AS tb
           FROM (SELECT n, name, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM (VALUES {_TEMPLATES}) AS v(n, name, body))),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_BIGRAMS} AS bg
      FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)),
p AS (SELECT rid, n, name, tb, size, bg FROM d JOIN t ON list_has_any(bg, tb) AND len(list_intersect(bg, tb)) * (2 - {licenses.THRESHOLD}) >= {licenses.THRESHOLD} * len(tb) - 1e-9),
w AS (SELECT rid, n, name, tb, i, list_distinct(bg[i:i + size - 2]) AS a
      FROM (SELECT *, unnest(range(1, greatest(len(bg) - size + 2, 1) + 1)) AS i FROM p)),
s AS (SELECT rid, n, name, i, 2 * len(list_intersect(a, tb)) / (len(a) + len(tb)) AS dice FROM w),
b AS (SELECT rid, n, name, max(dice) AS dice, min(i) AS i
      FROM (SELECT *, max(dice) OVER (PARTITION BY rid, n) AS top FROM s) WHERE dice = top AND dice >= {licenses.THRESHOLD} GROUP BY rid, n, name),
f AS (SELECT rid, arg_min(name, r) AS license, arg_min(dice, r) AS dice, arg_min(i, r) - 1 AS first_word, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses
      FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, n) AS r FROM b) GROUP BY rid)
SELECT doc_id, license, coalesce(dice, 0.0) AS dice, coalesce(first_word, -1) AS first_word, coalesce(licenses, '') AS licenses FROM d LEFT JOIN f USING (rid)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_url_filter,
        op3_nearest_neighbours,
        op4_simhash_near_dedup,
        op5_token_counts,
        op6_benchmark_decontamination,
        op7_quality_classifier,
        op8_packing,
        op9_license_scan,
        op10_toxicity,
    )
}
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op6_benchmark_decontamination": OP6_SQL, "op9_license_scan": OP9_SQL}
