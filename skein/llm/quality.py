"""Quality rules by host, in DataFrame operations only.

Each document gets its counts and the base rules' verdict inside its own row: words, sorted hashes
of three-word windows and lines are arrays, so no text moves. Failures are summed by host (one row
for each host and task), hosts' failure rates are shrunk with a beta prior fitted to all hosts by
moments, and the hosts' verdicts are joined back. A host is rejected where its shrunk rate is over
``max_rate``: the default of one half drops a host's documents only where most of them fail.

Base rules: a document fails with fewer than 50 words, or with over half of its words in three-word
windows that its text holds twice or more.

Defined cases: a null text has no words and fails; a null source is the host ''; repeated rows count
each; windows are told apart by 64-bit hashes inside one document; other columns pass through
``judged``; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import free_names, read_table, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_RATE = 0.5
#: The prior counts as so many documents at least and at most.
PRIOR_FROM, PRIOR_TO = 2.0, 10_000.0
SYMBOLS = "[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash comes up again, from the hashes in the text's order."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda s: F.sort_array(
        F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    # arrays of one bind a value once
    return F.get(F.transform(F.transform(F.array(ranked), again), covered), 0)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: filters and later columns that use it are not merged into it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def features(docs: DataFrame, text_name: str = "text", source: str = "source") -> DataFrame:
    """docs with host, the counts and base_failed, in place of columns of these names."""
    text = F.coalesce(F.col(text_name), F.lit(""))
    words_name, lines_name, hashes_name, counts_name = free_names(docs, "words", "lines", "hashes", "counts")
    words, n = F.col(words_name), F.size(words_name)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    hashes, lines = F.col(hashes_name), F.col(lines_name)
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, f"{SYMBOLS}+", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(hashes.isNull() | (F.size(F.array_distinct(hashes)) == F.size(hashes)), F.lit(0)).otherwise(_repeat_words(hashes)).cast("long").alias("n_repeat_words"),
    )
    split = _once(docs, words_name, F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    split = _once(split, lines_name, F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    counted = _once(_once(split, hashes_name, windows), counts_name, counts)
    rest = [c for c in docs.columns if c.lower() not in (*COUNTS, "host", "base_failed")]
    out = counted.select(*rest, F.coalesce(F.col(source), F.lit("")).alias("host"), *[F.col(counts_name)[c].alias(c) for c in COUNTS])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(featured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n, failures, rate, host_kept) from rows with host and base_failed."""
    hosts = featured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    hosts = written(hosts, "hosts")
    rate = F.col("failures") / F.col("n")
    # one row of sums over the hosts: the moments of the rates
    s = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("f"), F.count("*").alias("hosts"), F.sum(F.col("n") * rate * rate).alias("squares")).first()
    n, f = s["n"] or 0, s["f"] or 0
    mean = f / n if n else 0.0
    between = (s["squares"] / n - mean * mean - mean * (1 - mean) * s["hosts"] / n) if n else 0.0
    weight = min(PRIOR_TO, max(PRIOR_FROM, mean * (1 - mean) / between - 1)) if between > 0 else PRIOR_TO
    shrunk = (F.col("failures") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("rate", shrunk).withColumn("host_kept", F.col("rate") <= max_rate)


def judged(featured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """featured with rate and kept."""
    joined = featured.join(verdicts.select("host", "rate", "host_kept"), "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host_kept")


def kept_documents(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The documents that pass, under the same columns. Counts are made twice, which costs less than moving the texts."""
    own = dict(zip(docs.columns, (f"c{k}" for k in range(len(docs.columns))), strict=True))  # so that no column can clash with those that are added
    only = features(docs.toDF(*own.values()), own["text"], own["source"])
    return judged(only, host_verdicts(only, max_rate)).filter("kept").select(*own.values()).toDF(*own)


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    featured = written(features(docs).select("doc_id", "host", *COUNTS, "base_failed"), "features")
    return judged(featured, host_verdicts(featured)).select("doc_id", *COUNTS, "base_failed", "kept")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS win FROM g),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM h) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(ls) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM c),
hosts AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS x FROM f GROUP BY host),
m AS (SELECT sum(x) / sum(n) AS mean, count(*) / sum(n) AS inv, sum(x * x / n) / sum(n) AS sq FROM hosts),
b AS (SELECT mean, sq - mean * mean - mean * (1 - mean) * inv AS v FROM m),
p AS (SELECT mean, CASE WHEN v > 0 THEN least({PRIOR_TO}, greatest({PRIOR_FROM}, mean * (1 - mean) / v - 1)) ELSE {PRIOR_TO} END AS s FROM b),
verdict AS (SELECT host, (x + mean * s) / (n + s) <= {MAX_RATE} AS host_kept FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM f JOIN verdict USING (host)
"""
QUERIES = {"op8_host_rules": op8_host_rules}
ORACLES = {"op8_host_rules": SQL}
