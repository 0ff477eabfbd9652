"""Quality rules at the level of hosts, in DataFrame functions only.

Each document gets rule counts from its own text. A document fails softly by the number of rules in SOFT that it breaks. Soft failures are
aggregated by host, each host's failure rate is shrunk by a beta prior fitted to all hosts (method of moments), and the verdict is joined back: a document
of a host with a shrunk rate over host_limit may break no soft rule, any other document one. Hard rules (base_failed) always drop a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, narrow, write_shared

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: name -> SQL condition that breaks the rule.
SOFT = {
    "many_symbols": "10 * n_symbols > n_words",
    "very_many_symbols": "n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "odd_word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def rule_counts(df: DataFrame, **columns: str) -> DataFrame:
    """doc_id, host, and the counts of each text. No shuffle, no Python; arrays of one text at a time are held."""
    docs = narrow(df, **columns).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumns({"bare": F.btrim("text", F.lit(SPACE_CHARS)), "lines": F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")})
    docs = docs.withColumn("w", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", r"[\x20\x09-\x0D]+", -1)))
    docs = docs.select(
        "doc_id",
        "host",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # Windows of three words as (64-bit hash, start), sorted: equal windows are neighbours.
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("windows", F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))))
    again = F.filter("windows", lambda x, k: (x["h"] == F.get("windows", k - 1)["h"]) | (x["h"] == F.get("windows", k + 1)["h"]))
    docs = docs.withColumn("again", F.array_sort(F.transform(again, lambda x: x["i"])))
    # Each window found again covers the words that no window before it covers.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("again", start, lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"])
    return docs.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def host_verdicts(counts: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """host, n, failed, rate (shrunk), bad of each host; counts: a row per document with host and soft (number of broken soft rules).

    The prior is beta(mean * strength, (1 - mean) * strength): mean is the overall rate, strength comes from the spread of the
    hosts' rates beyond that of chance. Where hosts differ no more than by chance, the strength is 1e6 and all get the mean.
    """
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("soft") > 0).cast("long")).alias("failed"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares")).first()
    if not total.n:
        return hosts.select("host", "n", "failed", F.lit(0.0).alias("rate"), F.lit(False).alias("bad"))
    mean = total.failed / total.n
    spread = total.squares / total.n - mean * mean  # weighted variance of the rates
    chance = mean * (1 - mean) * total.hosts / total.n
    between = spread - chance
    strength = min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate > host_limit).alias("bad"))


def host_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; then n_lines, soft, host_rate, host_bad.

    A null text is empty (and so fails the base rules); documents with a null host make up one host. Rows that repeat are each
    judged and each counted. An empty table gives none. Counts go to a table in the shared folder, so that texts are read once.
    The host table is joined by Catalyst's choice: broadcast if small, else by a shuffle that splits hot hosts.
    """
    counts = rule_counts(df, doc_id=id_col, text=text_col, host=host_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = sum((F.expr(f"cast(({c}) as int)") for c in SOFT.values()), F.lit(0))
    counts = write_shared(counts.withColumns({"base_failed": failed, "soft": soft}), "rule-counts")
    hosts = write_shared(host_verdicts(counts, host_limit), "hosts").select(F.col("host").alias("its_host"), F.col("rate").alias("host_rate"), F.col("bad").alias("host_bad"))
    both = counts.join(hosts, F.col("host").eqNullSafe(F.col("its_host")), "left")
    kept = ~F.col("base_failed") & (F.col("soft") <= F.when(F.col("host_bad"), 0).otherwise(1))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", "soft", "host_rate", "host_bad")


#: The same in DuckDB's SQL, for the columns of the documents table.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY r),
c AS (
  SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (10 * n_symbols > n_words)::INT + (n_symbols > n_words)::INT + (10 * n_dup_lines > 3 * n_lines)::INT + (100 * n_repeat_words > 20 * n_words)::INT
         + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS soft
  FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, sum((soft > 0)::INT)::DOUBLE AS failed FROM s GROUP BY source),
t AS (SELECT sum(failed) / sum(n) AS mean, sum(failed * failed / n) / sum(n) - (sum(failed) / sum(n)) ** 2 - (sum(failed) / sum(n)) * (1 - sum(failed) / sum(n)) * count(*) / sum(n) AS between_ FROM h),
p AS (SELECT mean, CASE WHEN between_ > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / between_ - 1)) ELSE 1e6 END AS strength FROM t),
v AS (SELECT source, (failed + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND soft <= CASE WHEN rate > 0.5 THEN 0 ELSE 1 END AS kept
FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source
"""
