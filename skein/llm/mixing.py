"""Mixing sources to target weights by iterative proportional fitting (raking), in DataFrame operations only.

Tokens are summed by cell (source, language, topic). Starting at the cells' token shares, each sweep
scales the cells so that the shares of every source, then of every language, then of every topic are
the targets; sweeps go on until all shares are within TOLERANCE. A cell's calibrated weight over its
token share says how much denser it has to be; documents are kept with a probability in proportion to
that, at most 1, such that the expected number of tokens kept is ``budget`` times the total. The draw is a hash of seed and doc_id: runs agree, and a
document keeps its draw whatever else is in the corpus.

Targets default to token shares to the power of ``temper``, brought to a sum of 1, which lifts small
sources, languages and topics; ``targets`` gives shares by value instead.

Plan: one row for each cell and task is shuffled to sum tokens. Raking is windows over the cells' table;
up to ONE_TASK_CELLS cells lie in one partition, where the windows need no exchange, and beyond that they
are dealt out by value. Cells are joined back to the documents, whose texts don't move.

Defined cases: null source, language or topic is the value ''; a null text has 0 tokens and topic
'empty'; a cell without tokens has weight 0 and probability 0; target shares of values that don't
occur go to the others in proportion; a null doc_id has one draw for all its rows; repeated rows have
equal draws; other columns pass through ``sample``; an empty table stays empty.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import packed, read_table, written

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.7
#: Sweeps between two looks at the marginals, which are met when all shares are within TOLERANCE of their targets.
SWEEPS = 6
TOLERANCE = 1e-6
BUDGET = 0.5
SEED = 17
ONE_TASK_CELLS = 200_000
log = logging.getLogger(__name__)


def tokens_of(text: str = "text") -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: str = "text") -> Column:
    """A coarse topic from the text's form, for tables without a topic column."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(t == "", "empty")
        .when(F.contains(F.lower(t), F.lit("license")) | F.contains(F.lower(t), F.lit("copyright")), "legal")
        .when(F.contains(t, F.lit("@")), "contact")
        .when(F.rlike(t, F.lit("[0-9]{3}")), "figures")
        .otherwise("prose")
    )


def _dims(topic: Column) -> dict[str, Column]:
    """Columns of the mixing's own names, so that a table's columns of any name can stay."""
    return {"_source": F.coalesce(F.col("source"), F.lit("")), "_lang": F.coalesce(F.col("lang"), F.lit("")), "_topic": F.coalesce(topic, F.lit(""))}


def cell_tokens(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(source, lang, topic, tokens) by cell."""
    rows = docs.select(*[c.alias(k) for k, c in _dims(topic_of() if topic is None else topic).items()], tokens_of().alias("tokens"))
    sums = rows.groupBy("_source", "_lang", "_topic").agg(F.sum("tokens").alias("tokens"))
    return sums.select(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS], "tokens")


def raked(cells: DataFrame, temper: float = TEMPER, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with share and weight, each of sum 1. Sweeps go on until the marginals are met, or come no nearer, which a warning tells."""
    few = cells.count() <= ONE_TASK_CELLS
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = cells.withColumn("share", F.col("tokens") / F.lit(float(total)))
    # target shares of the values that occur, brought to a sum of 1
    for d in DIMENSIONS:
        given = (targets or {}).get(d)
        by_value = out.groupBy(d).agg(F.sum("share").alias("own"))
        if given is None:
            by_value = by_value.withColumn("raw", F.pow("own", F.lit(temper)))
        else:
            pairs = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.lit(None).cast("map<string,double>")
            by_value = by_value.withColumn("raw", F.when(F.col("own") > 0, F.coalesce(F.try_element_at(pairs, F.col(d)), F.lit(0.0))).otherwise(0.0))
        by_value = written(by_value, "targets")
        whole = by_value.agg(F.sum("raw")).first()[0] or 1.0
        out = out.join(by_value.select(d, (F.col("raw") / F.lit(whole)).alias(f"target_{d}")), d)
    out = written(out.withColumn("weight", F.col("share")), "raking")
    before = float("inf")
    while True:
        out = out.coalesce(1) if few else out
        for _ in range(SWEEPS):
            for d in DIMENSIONS:
                at = F.sum("weight").over(Window.partitionBy(d))
                out = out.withColumn("weight", F.when(at > 0, F.col("weight") * F.col(f"target_{d}") / at).otherwise(0.0))
        out = written(out, "raking")  # plans stay short
        gap = marginal_gap(out)
        if gap <= tolerance:
            break
        if gap > 0.99 * before:
            log.warning("raking ends with a share %.3g off its target: the targets fit no weights of these cells", gap)
            break
        before = gap
    return out.select(*DIMENSIONS, "tokens", "share", "weight")


def marginal_gap(weighted: DataFrame) -> float:
    """How far the share of a source, language or topic is from its target at most, from cells with weight and targets."""
    gaps = [weighted.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"target_{d}")).alias("gap")).agg(F.max("gap").alias("gap")) for d in DIMENSIONS]
    return gaps[0].union(gaps[1]).union(gaps[2]).agg(F.max("gap")).first()[0] or 0.0


def calibrated(weights: DataFrame, budget: float = BUDGET) -> DataFrame:
    """weights with probability: min(1, c * weight / share), with c such that budget * total tokens are expected."""
    ratio = F.when(F.col("share") > 0, F.col("weight") / F.col("share")).otherwise(0.0)
    rows = weights.withColumn("ratio", ratio)
    c, capped_before = float(budget), -1.0
    while True:  # ends: the cells at 1 only become more
        full = F.col("ratio") * F.lit(c) >= 1
        s = rows.agg(F.sum(F.when(full, F.col("share")).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest")).first()
        capped, rest = s["capped"] or 0.0, s["rest"] or 0.0
        if capped <= capped_before or rest <= 0:
            break
        c, capped_before = max(c, (budget - capped) / rest), capped
    return rows.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * F.lit(c))).drop("ratio")


def draw_of(seed: int = SEED) -> Column:
    """A number from 0 to 1 that seed and doc_id decide."""
    digits = F.substring(F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def _drawn(keyed: DataFrame, probabilities: DataFrame, seed: int) -> DataFrame:
    """keyed (with doc_id and the dimensions) with _weight, _probability and _sampled."""
    cells = probabilities.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    return keyed.join(cells, ["_source", "_lang", "_topic"], "left").withColumn("_sampled", draw_of(seed) < F.col("_probability"))


def sample(docs: DataFrame, probabilities: DataFrame, topic: Column | None = None, seed: int = SEED) -> DataFrame:
    """docs with _source, _lang, _topic, _weight, _probability and _sampled (names of their own; ``mixed`` stands any)."""
    return _drawn(docs.withColumns(_dims(topic_of() if topic is None else topic)), probabilities, seed)


def mixed(docs: DataFrame, budget: float = BUDGET, temper: float = TEMPER, targets: dict | None = None) -> DataFrame:
    """The sampled documents, under the same columns."""
    probabilities = calibrated(raked(written(cell_tokens(docs), "cells"), temper, targets), budget)
    keyed = packed(docs, "doc_id", *[c.alias(k) for k, c in _dims(topic_of()).items()])
    return _drawn(keyed, probabilities, SEED).filter("_sampled").select("row.*")


def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    probabilities = calibrated(raked(written(cell_tokens(docs), "cells")))
    done = sample(docs, probabilities)
    return done.select(
        "doc_id",
        *[F.col(f"_{d}").alias(d) for d in DIMENSIONS],
        tokens_of().alias("tokens"),
        F.round("_weight", 9).alias("weight"),
        F.round("_probability", 9).alias("probability"),
        F.col("_sampled").alias("sampled"),
    )


def _sql() -> str:
    parts = [
        r"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents)""",
        """k AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN contains(lower(t), 'license') OR contains(lower(t), 'copyright') THEN 'legal'
  WHEN contains(t, '@') THEN 'contact' WHEN regexp_matches(t, '[0-9]{3}') THEN 'figures' ELSE 'prose' END AS topic FROM d)""",
        "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM k GROUP BY ALL)",
        "s AS (SELECT *, tokens / (SELECT sum(tokens) FROM c) AS share FROM c)",
    ]
    for d in DIMENSIONS:
        parts.append(f"r_{d} AS (SELECT {d}, pow(sum(share), {TEMPER}) AS raw FROM s GROUP BY {d})")
        parts.append(f"t_{d} AS (SELECT {d}, raw / (SELECT sum(raw) FROM r_{d}) AS target_{d} FROM r_{d})")
    at = {d: f"sum(weight) OVER (PARTITION BY {d})" for d in DIMENSIONS}
    sweeps = "SELECT * FROM w WHERE NOT done"
    for d in DIMENSIONS * SWEEPS:
        sweeps = f"SELECT * REPLACE (CASE WHEN {at[d]} > 0 THEN weight * target_{d} / {at[d]} ELSE 0 END AS weight) FROM ({sweeps})"
    gap = "greatest(" + ", ".join(f"abs({at[d]} - target_{d})" for d in DIMENSIONS) + ")"
    # rounds of sweeps until the marginals are met, or come no nearer
    parts.append(f"""w AS (SELECT s.*, target_source, target_lang, target_topic, share AS weight, 'inf'::DOUBLE AS gap, false AS done
    FROM s JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
  UNION ALL SELECT source, lang, topic, tokens, share, target_source, target_lang, target_topic, weight, now, now <= {TOLERANCE} OR now > 0.99 * gap
    FROM (SELECT *, max(own) OVER () AS now FROM (SELECT *, {gap} AS own FROM ({sweeps}))))""")
    return "WITH RECURSIVE " + ",\n".join(
        [
            *parts,
            "q AS (SELECT *, CASE WHEN share > 0 THEN weight / share ELSE 0 END AS ratio FROM w WHERE done)",
            # the first cell, from the densest on, that isn't certain if all before it are
            """o AS (SELECT ratio, coalesce(sum(share) OVER (ORDER BY ratio DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS capped,
  sum(weight) OVER (ORDER BY ratio DESC RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM q)""",
            f"b AS (SELECT max_by(({BUDGET} - capped) / rest, ratio) AS c FROM o WHERE rest > 0 AND ({BUDGET} - capped) / rest * ratio <= 1)",
            "p AS (SELECT source, lang, topic, weight, least(1.0, ratio * c) AS probability FROM q, b)",
            f"""u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM k)
SELECT doc_id, source, lang, topic, tokens, round(weight, 9) AS weight, round(probability, 9) AS probability, draw < probability AS sampled
FROM u JOIN p USING (source, lang, topic)""",
        ]
    )


QUERIES = {"op4_raked_mixture": op4_raked_mixture}
ORACLES = {"op4_raked_mixture": _sql()}
