"""Risk: five factors, each over its greatest value, weighted, summed, banded and explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.constants import RISK_WEIGHTS
from loomgraph.functions.text import risk_level


def reasons(high: Column, medium: Column) -> Column:
    """Why a row has its level, from factor_centrality, in_degree, failed, complexity and risk_level."""
    number = lambda text, c: F.format_string(text, c.cast("int"))
    c, n, x = F.col("factor_centrality"), F.col("in_degree"), F.col("complexity")
    found = F.array_compact(F.array(
        F.when(c > 0.5, "High graph centrality — critical bridge in dependency network").when(c > 0.2, "Moderate centrality — several files route through this"),
        F.when(n >= 5, number("%d files depend on this — failure has wide impact", n)).when(n >= 2, number("%d files depend on this", n)),
        F.when(high > 0, number("%d high-severity issue(s) detected", high)),
        F.when(medium > 0, number("%d medium-severity issue(s)", medium)),
        F.when(F.col("failed"), "Failed execution/compile check"),
        F.when(x > 20, number("High complexity score (%d) — difficult to maintain", x)).when(x > 10, number("Moderate complexity (%d)", x)),
    ))
    plain = F.array(F.concat(F.lit("Low overall risk — "), "risk_level", F.lit(" dependency footprint")))
    return F.when(F.size(found) == 0, plain).otherwise(found)


def failed(compile_ok: Column, runtime_ok: Column) -> Column:
    """Whether a file does not compile or did not run; one that was not run, with null, has not failed."""
    return ~compile_ok | runtime_ok.eqNullSafe(False)


def score(rows: DataFrame) -> DataFrame:
    """rows: centrality, in_degree, weight, failed, complexity. Adds risk_score, risk_level and the five parts.

    A greatest value of 0 counts as 1; the parts are added from left to right.
    """
    top = lambda c: F.coalesce(F.nullif(F.max(c), F.lit(0)), F.lit(1)).cast("double").alias(f"top_{c}")
    tops = rows.agg(*[top(c) for c in ("centrality", "in_degree", "weight", "complexity")])
    joined = rows.crossJoin(F.broadcast(tops))  # one row
    factor = {
        "centrality": F.col("centrality") / F.col("top_centrality"),
        "in_degree": F.col("in_degree") / F.col("top_in_degree"),
        "errors": F.col("weight") / F.col("top_weight"),
        "execution": F.when(F.col("failed"), 1.0).otherwise(0.0),
        "complexity": F.col("complexity") / F.col("top_complexity"),
    }
    named = joined.withColumns({f"factor_{k}": v for k, v in factor.items()})
    total = None
    for k, w in RISK_WEIGHTS.items():
        part = F.lit(w) * F.col(f"factor_{k}")
        total = part if total is None else total + part
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    kept = named.withColumn("risk_score", clamped).withColumn("risk_level", risk_level(F.col("risk_score")))
    return kept.drop(*[f"top_{c}" for c in ("centrality", "in_degree", "weight", "complexity")])


def highest(scored: DataFrame, most: int, *ties) -> DataFrame:
    return scored.where("risk_level = 'high'").orderBy(F.desc("risk_score"), *ties).limit(most)


def counts(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.count_if(F.col("risk_level") == x).alias(x) for x in ("high", "medium", "low")])
