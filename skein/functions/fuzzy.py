"""Approximate names: the best symbol by longest-matching-blocks ratio, with a lossless index of q-grams.

A ratio of t between a and b means that M >= t * (|a| + |b|) / 2 characters lie in matching blocks. Blocks keep their order,
so b comes from a by taking out |a| - M characters and putting in |b| - M. One taken out breaks two at most of the
pairs of neighbours (with an end mark on either side) that a has, one put in breaks one: at least
|a| + 1 - 2 (|a| - M) - (|b| - M) pairs are left in both, counted with repeats. That is over 0 for any t over two thirds;
for lower thresholds single letters take the pairs' place, of which M are left.

Each string is the set of its numbered grams (the second "ab" is not the first), ordered by how many strings of the
two tables hold them. Strings that share so many grams hold one of them among their first few in that order (prefix
filtering: Chaudhuri et al., 2006), so an equi-join on each string's few rarest grams, and on both lengths, finds every pair:
the shorter the reach between two lengths, the fewer grams. A pair is kept where
the gram is the first that both have, so each comes up once; pairs with too few shared grams go, and those that
need more edits than blocks of that size leave. Only the rest is compared. Both sides of the join are tables
of different strings, so that a gram which very many hold can be split.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.shared import ship, stored

THRESHOLD = 0.85
#: Below, pairs of letters may all be broken, and single ones are the grams.
PAIRS_FROM = 0.7


@F.pandas_udf(T.DoubleType())
def ratio(name: pd.Series, symbol: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(name, symbol, strict=True)])


def grams(text: Column, q: int) -> Column:
    """The q-grams of a text with their numbers among equal ones; for q = 2 with an end mark on either side."""
    if q == 1:
        parts = F.filter(F.split(text, ""), lambda c: c != "")
    else:
        marked = F.concat(F.lit("\0"), text, F.lit("\0"))
        parts = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda k: F.substr(marked, k, F.lit(2)))
    ordered = F.array_sort(parts)
    return F.transform(ordered, lambda c, k: F.concat(c, F.lit("\0"), (k + 1 - F.array_position(ordered, c)).cast("string")))


def _matched(length: Column, threshold: float) -> Column:
    """How many characters of two strings, of this length together, match if they reach the threshold."""
    return F.ceil(length * F.lit(threshold / 2) - F.lit(1e-9)).cast("int")


def _shared(a: Column, b: Column, threshold: float, q: int) -> Column:
    """How many grams strings of these lengths share at least."""
    matched = _matched(a + b, threshold)
    return matched if q == 1 else 3 * matched - a - b + 1


def _reach(n: Column, threshold: float) -> Column:
    """The lengths in reach of a length."""
    return F.sequence(F.ceil(n * F.lit(threshold / (2 - threshold)) - F.lit(1e-9)).cast("int"), F.floor(n * F.lit((2 - threshold) / threshold) + F.lit(1e-9)).cast("int"))


def _few_edits(a: Column, b: Column, a_n: Column, b_n: Column, threshold: float) -> Column:
    """Blocks of the threshold's size leave so many characters to take out and put in; an exchange is one of each."""
    return F.levenshtein(a, b) <= a_n + b_n - 2 * _matched(a_n + b_n, threshold)


def _indexed(strings: DataFrame, counts: DataFrame, threshold: float, q: int) -> DataFrame:
    """(text, n, other, grams, gram): each string, for each length in reach, under each gram that it could share first with a string of that length."""
    n = F.length("text")
    each = strings.select("text", F.explode(grams(F.col("text"), q)).alias("gram")).join(counts, "gram")
    ordered = each.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("holders", "gram"))), lambda x: x["gram"]).alias("grams"))
    lengths = ordered.select("text", n.alias("n"), "grams", F.explode(_reach(n, threshold)).alias("other"))
    first = F.slice("grams", F.lit(1), F.greatest(F.size("grams") - _shared(F.col("n"), F.col("other"), threshold, q) + 1, F.lit(1)))
    out = lengths.select("text", "n", "other", "grams", F.explode(first).alias("gram"))
    return out if q == 2 else out.union(strings.filter("text = ''").select("text", F.lit(0), F.lit(0), F.array().cast("array<string>"), F.lit("")))


def joined(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Strings a and b (columns of these names) whose lengths are in reach and that share a gram among their first few, once for each such gram."""
    q = 2 if threshold >= PAIRS_FROM else 1
    left, right = (stored(t.select(F.col(c).alias("text")).distinct(), "strings") for t, c in ((a, "a"), (b, "b")))
    every = left.union(right).select(F.explode(grams(F.col("text"), q)).alias("gram"))
    counts = stored(every.groupBy("gram").agg(F.count("*").alias("holders")), "grams")
    names = (("a", "a_n", "b_n", "a_grams"), ("b", "b_n", "a_n", "b_grams"))
    sides = [stored(_indexed(t, counts, threshold, q).toDF(*own, "gram"), "indexed") for t, own in zip((left, right), names, strict=True)]
    return sides[0].join(sides[1], ["gram", "a_n", "b_n"])


def candidates(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): strings that the bounds leave in reach of the threshold, each pair once."""
    q = 2 if threshold >= PAIRS_FROM else 1
    shared = F.array_intersect("a_grams", "b_grams")
    once = F.coalesce(F.get(shared, 0), F.lit("")) == F.col("gram")
    enough = F.size(shared) >= _shared(F.col("a_n"), F.col("b_n"), threshold, q)
    edits = _few_edits(F.col("a"), F.col("b"), F.col("a_n"), F.col("b_n"), threshold)
    return joined(a, b, threshold).filter(once & enough & edits).select("a", "b")


def in_reach(symbols: DataFrame, names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of symbols (name, ...) that lengths and edits leave in reach of some of names, which are few and go to every
    task: a question's words. No symbol is indexed, moved or grouped for it."""
    few = names.select(F.lower("name").alias("near")).distinct().withColumn("near_n", F.length("near"))
    few = few.select("near", "near_n", F.explode(_reach(F.col("near_n"), threshold)).alias("n"))
    own, n = F.lower("name"), F.length(F.lower("name"))
    close = _few_edits(F.col("near"), own, F.col("near_n"), n, threshold)
    return symbols.join(F.broadcast(few), (n == F.col("n")) & close, "left_semi")


def best_symbols(names: DataFrame, symbols: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(name, symbol, id, ratio): each name's best symbol, the first by seq among equals, if it reaches the threshold."""
    ship(names.sparkSession)
    a = names.select("name").distinct().withColumn("a", F.lower("name"))
    b = symbols.groupBy(F.lower("name").alias("b")).agg(F.min(F.struct("seq", F.col("name").alias("symbol"), "id")).alias("first"))
    scored = candidates(a, b, threshold).withColumn("ratio", ratio("a", "b")).filter(F.col("ratio") >= threshold)
    of_each = stored(scored.join(b, "b").select("a", "ratio", "first"), "scored")
    best = of_each.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("rank"), "first", "ratio")).alias("best"))
    return a.join(stored(best, "best"), "a").select("name", "best.first.symbol", "best.first.id", "best.ratio")
