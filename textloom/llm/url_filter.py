"""Operator 2: URL filter by rules and by a character language-model ratio.

Rules judge first: a rule (host, path) fits its host and all subdomains if the
URL's path starts with the rule's; the longest rule (host and path together)
wins, the earlier of equally long ones.  The URLs that rules judge train two
smoothed variable-order Markov models over characters, one for allowed and one
for blocked URLs.  A URL that no rule fits is blocked if the mean over its
characters of log p(allow) - log p(block) is under a threshold; that threshold is
calibrated on a fifth of the judged URLs (by crc32) which the models never saw,
where it makes the balanced accuracy largest.

The models: p_k(c | last k characters) = (n + LAMBDA p_(k-1)) / (N + LAMBDA), p_(-1)
uniform; the longest context that was seen is used.  Characters outside a fixed
alphabet become one symbol, so there are at most ``len(ALPHABET) ** ORDER``
contexts of the longest order, whatever the input: the bound of what is broadcast.

All of it is DataFrame operations.

Defined cases: a null URL, or one without ``://``, has an empty host and path; no
rule fits it and its score is 0, as has any URL with no characters.  With no URLs
judged on one side the threshold is 0 and a score of 0 allows.  Repeated rows
each get a row.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower, pick, stored

#: ^ pads the start, $ ends a URL, ~ is any other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%#:~$^"
ORDER = 3
LAMBDA = 4.0
#: Thresholds tried are multiples of STEP up to STEPS from zero.
STEP = 0.02
STEPS = 200
#: (verdict, host, path)
Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the winning rule, or null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _symbols(url: Column) -> Column:
    """What the models read: the URL after its scheme over the alphabet, padded."""
    after = F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), r"(?s)^.*?://", "")
    plain = F.regexp_replace(after, r"(?s)[^a-z0-9./\-_?=&%#:]", "~")
    return F.when(plain == "", F.lit(None).cast("string")).otherwise(F.concat(F.lit("^" * ORDER), plain, F.lit("$")))


def _characters(rows: DataFrame) -> DataFrame:
    """A row a character: its symbol ``c`` and the ORDER symbols before (``ctx``)."""
    at = F.explode(F.sequence(F.lit(ORDER + 1), F.length("symbols"))).alias("at")
    put = rows.where(F.col("symbols").isNotNull()).select("*", at)
    return put.withColumn("c", F.substr("symbols", F.col("at"), F.lit(1))).withColumn("ctx", F.substr("symbols", F.col("at") - ORDER, F.lit(ORDER)))


def _models(counts: DataFrame) -> list[DataFrame]:
    """For each order k: ctx (k symbols) and ``lr``, the array over the alphabet
    of the log ratio; and the smoothed probabilities pa and pb."""
    size = len(ALPHABET)
    whole = F.transform(F.lit([0] * size), lambda _: F.lit(1.0 / size))
    uniform = counts.sparkSession.range(1).select(F.lit("").alias("lower"), whole.alias("qa"), whole.alias("qb"))
    tables, below = [], uniform
    for k in range(ORDER + 1):
        ctx = F.substr("ctx", F.lit(ORDER - k + 1), F.lit(k)) if k else F.lit("")
        sums = counts.groupBy(ctx.alias("ctx"), "c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
        # at most one entry a symbol
        seen = sums.groupBy("ctx").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("na", "nb")))).alias("n"), F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
        under = seen.withColumn("lower", F.substr("ctx", F.lit(2), F.lit(max(k - 1, 0))) if k else F.lit("")).join(F.broadcast(below), "lower")
        symbols = F.lit(list(ALPHABET))

        def mixed(n: str, total: str, q: str, symbols=symbols) -> Column:
            return F.transform(symbols, lambda c, i: (F.coalesce(F.try_element_at("n", c)[n], F.lit(0)) + F.lit(LAMBDA) * F.element_at(q, i + 1)) / (F.col(total) + LAMBDA))

        model = under.select("ctx", mixed("na", "ta", "qa").alias("pa"), mixed("nb", "tb", "qb").alias("pb"))
        model = stored(model.withColumn("lr", F.zip_with("pa", "pb", lambda a, b: F.ln(a) - F.ln(b))), f"markov-{k}")
        tables.append(model.select("ctx", "lr"))
        below = model.select(F.col("ctx").alias("lower"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
    return tables


def _scores(rows: DataFrame, models: list[DataFrame]) -> DataFrame:
    """rid and mean log ratio of each row with characters."""
    chars = _characters(rows.select("rid", "symbols")).select("rid", "ctx", F.instr(F.lit(ALPHABET), F.col("c")).alias("i"))
    for k in range(ORDER, -1, -1):
        ctx = F.substr("ctx", F.lit(ORDER - k + 1), F.lit(k)) if k else F.lit("")
        table = models[k].select(F.col("ctx").alias(f"ctx{k}"), F.col("lr").alias(f"lr{k}"))
        chars = chars.withColumn(f"key{k}", ctx).join(F.broadcast(table), F.col(f"key{k}") == F.col(f"ctx{k}"), "left")
    # the longest context that was seen
    ratio = F.element_at(F.coalesce(*(F.col(f"lr{k}") for k in range(ORDER, -1, -1))), F.col("i"))
    return chars.groupBy("rid").agg(F.avg(F.coalesce(ratio, F.lit(0.0))).alias("score"))


def _threshold(scores: DataFrame) -> float:
    """The threshold of largest balanced accuracy; the middle one of equals."""
    step = F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.floor(F.col("score") / STEP))).cast("int")
    rows = scores.groupBy(step.alias("step")).agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("a"), F.sum((F.col("verdict") == "block").cast("long")).alias("b")).collect()
    allow, block = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not allow or not block:
        return 0.0
    at = {t: sum(r["a"] for r in rows if r["step"] >= t) / allow + sum(r["b"] for r in rows if r["step"] < t) / block for t in range(-STEPS, STEPS + 1)}
    best = [t for t, v in at.items() if v >= max(at.values()) - 1e-12]
    return STEP * best[len(best) // 2]


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row."""
    rows = pick(pages, page_id=id_col, url=url_col)
    host, path = split_url(F.col("url"))
    rows = rows.select("page_id", F.monotonically_increasing_id().alias("rid"), host.alias("host"), path.alias("path"), _symbols(F.col("url")).alias("symbols"), (F.crc32(F.coalesce(F.col("url"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out"))
    rows = stored(rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("*", "found.rule", "found.verdict").drop("found"), "urls")
    judged = rows.where(F.col("verdict").isNotNull() & ~F.col("held_out"))
    counts = _characters(judged).groupBy("ctx", "c").agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("na"), F.sum((F.col("verdict") == "block").cast("long")).alias("nb"))
    scores = stored(_scores(rows, _models(stored(counts, "url-counts"))), "url-scores")
    threshold = _threshold(rows.where(F.col("verdict").isNotNull() & F.col("held_out")).select("rid", "verdict").join(scores, "rid"))
    judged = rows.join(scores, "rid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    own = F.when((F.col("score") >= threshold) | F.col("symbols").isNull(), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
