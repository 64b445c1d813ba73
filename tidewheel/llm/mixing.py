"""Mixing sources to target weights by temperature.

Source shares of all tokens are raised to an exponent between 0 (all sources alike) and 1 (as they
are) and normalised. Bisection finds the exponent that meets a target: the least one under which no
source is repeated more than `max_repeats` times, or the one whose weights reach a share `entropy` of
the greatest entropy. Each source's token budget is then realised in blocks: every full pass over the
source is a permutation of it, and the last, partial block is the beginning of one. Permutations are
orders by md5 of id and block, so a block needs no shuffle: the partial one ends at a cut key that is
found from sums over key prefixes. A row's `position`, between 0 and 1, is its place in the mixture:
blocks of a source follow each other and share the way evenly, so in order of position every source
is present throughout by its weight, each block in the order of its permutation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.sources.shared import materialise
from tidewheel.sources.tables import table

#: Sources whose figures travel to the driver and to every task; of more, sums are taken by Spark and the join is a shuffle.
FEW_SOURCES = 100_000
#: Documents that a key prefix of a source holds on average.
PER_PREFIX = 4096
#: Hexadecimal digits of a key that make its place in a block.
DIGITS = 13


@dataclass
class Mixture:
    exponent: float
    weights: dict[str | None, float]
    quotas: dict[str | None, int]


def bisect(holds, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """Least x at which the monotone `holds` is true, if it is at `high`."""
    if holds(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def exponent(low: int, top: int, count: int, sums: Callable[[float], tuple[float, float]], budget: int | None = None, max_repeats: float | None = None, entropy: float | None = None) -> float:
    """Exponent, to six decimals, for `count` sources of `low` to `top` tokens.

    `sums(x)` gives, over all sources with p = (tokens / top) ** x, the sum of p and that of p ln p.
    """

    def repeats(x: float) -> float:  # of the smallest source, which is repeated most
        share = (low / top) ** x
        return share * top / low if budget is None else budget * share / sums(x)[0] / low

    def evenness(x: float) -> float:
        total, logs = sums(x)
        return (math.log(total) - logs / total) / math.log(count) if count > 1 else 1.0

    x = 1.0
    if max_repeats is not None:
        x = bisect(lambda x: repeats(x) <= max_repeats + 1e-12)
    elif entropy is not None:
        x = 1 - bisect(lambda y: evenness(1 - y) >= entropy)
    return round(x, 6)


def temperature(tokens: dict[str | None, int], budget: int | None = None, max_repeats: float | None = None, entropy: float | None = None) -> Mixture:
    """Weights and token quotas. Without a budget the source that is repeated least gets one whole pass, so none is cut.

    Sources without tokens get weight and quota 0.
    """
    full = {s: n for s, n in tokens.items() if n > 0}
    if not full:
        return Mixture(1.0, dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 0))
    top = max(full.values())
    x = exponent(min(full.values()), top, len(full), local_sums(list(full.values())), budget, max_repeats, entropy)
    powers = {s: (n / top) ** x for s, n in full.items()}
    w = {s: p / sum(powers.values()) for s, p in powers.items()}
    quotas = {s: round(budget * w[s] if budget is not None else top * powers[s]) for s in full}
    return Mixture(x, {s: w.get(s, 0.0) for s in tokens}, {s: quotas.get(s, 0) for s in tokens})


def local_sums(tokens: list[int]) -> Callable[[float], tuple[float, float]]:
    logs = np.log(np.array(tokens, float) / max(tokens))

    def sums(x: float) -> tuple[float, float]:
        p = np.exp(x * logs)
        return float(p.sum()), float((p * x * logs).sum())

    return sums


def shared_sums(sources: DataFrame, top: int) -> Callable[[float], tuple[float, float]]:
    """As local_sums, by one aggregation a call over a row for each source."""
    log = F.log(F.col("n") / top)

    def sums(x: float) -> tuple[float, float]:
        p = F.exp(x * log)
        return tuple(sources.where("n > 0").agg(F.sum(p), F.sum(p * x * log)).first())

    return sums


def space_tokens(text: Column) -> Column:
    """Tokens between single spaces; none in a null or empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def order_key(doc_id: Column, block: Column) -> Column:
    """Place of a document in a permutation of its source."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), block.cast("string")))


def mix(df: DataFrame, tokens: Column | None = None, budget: int | None = None, max_repeats: float | None = 2.0, entropy: float | None = None, source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows of `df`, each as often as its source's quota asks for, with n_tokens, block and position; and the sources.

    The sources are (source, n, docs, weight, quota). A null source is a source of its own. Rows without
    tokens are in every full block and in the partial one up to its cut. Rows that share an id share
    their place in every permutation. A source that has no tokens at all gets one block. Null and empty
    texts have no tokens, very long ones are rows like others. An empty table gives an empty one.
    Columns that have the added names are replaced. Any number of sources will do: figures of up to
    FEW_SOURCES reach the driver and are broadcast, those of more stay in a table that is joined.
    """
    tokens = space_tokens(F.col("text")) if tokens is None else tokens
    counted = df.drop("block", "position").withColumn("n_tokens", tokens)
    narrow = counted.select(F.col(source).alias("s"), F.col(doc_id).cast("string").alias("i"), "n_tokens")
    found = materialise(narrow.groupBy("s").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")), "sources")
    positive = F.when(F.col("n") > 0, F.col("n"))
    all_sources, count, low, top, most = found.agg(F.count("*"), F.count(positive), F.min(positive), F.max(positive), F.max("docs")).first()
    few = all_sources <= FEW_SOURCES
    x, total = 1.0, 1.0
    if count:
        sums = local_sums([r["n"] for r in found.where("n > 0").select("n").collect()]) if few else shared_sums(found, top)
        x = exponent(low, top, count, sums, budget, max_repeats, entropy)
        total = sums(x)[0]
    power = F.pow(F.col("n") / F.lit(top or 1), F.lit(x))
    weight = F.when(F.col("n") > 0, power / total).otherwise(0.0)
    quota = F.when(F.col("n") > 0, F.round(power * top if budget is None else weight * budget)).otherwise(0).cast("long")
    sources = found.withColumns({"weight": weight, "quota": quota})
    some = F.col("n") > 0
    plan = sources.select(F.col("s").alias("of"), "n", "quota", F.when(some, F.floor(F.col("quota") / F.col("n"))).otherwise(1).alias("passes"), F.when(some, F.col("quota") % F.col("n")).otherwise(0).alias("rest"))
    small = F.broadcast if few else lambda side: side  # a row for each source

    hexes = max(1, math.ceil(math.log((most or 1) / PER_PREFIX + 1, 16)))
    same = F.col("s").eqNullSafe(F.col("of"))
    keyed = narrow.join(small(plan.where("rest > 0")), same).select("s", "rest", "n_tokens", order_key(F.col("i"), F.col("passes")).alias("key"))
    prefixed = keyed.withColumn("p", F.substring("key", 1, hexes))
    prefixes = prefixed.groupBy("s", "rest", "p").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    border = prefixes.withColumn("upto", F.sum("n").over(w)).where("upto - n <= rest AND upto > rest").select("s", "p", (F.col("upto") - F.col("n")).alias("before"))
    border = small(border.groupBy(F.col("s").alias("of")).agg(F.min("p").alias("at"), F.min_by("before", "p").alias("before")))
    inside = prefixed.join(border, same & (F.col("p") == F.col("at"))).select("s", "p", "rest", "before", "key", "n_tokens")
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("s", "p").orderBy("key"))  # rows that share a key stand or fall together
    last = inside.withColumn("upto", upto).groupBy("s", "p").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("key"))
    cuts = last.select(F.col("s").alias("cut_of"), F.coalesce("key", "p").alias("cut"))  # no key at the border fits: all keys before it do
    cut_plan = materialise(plan.join(small(cuts), F.col("of").eqNullSafe(F.col("cut_of")), "left").select(*[F.col(c).alias(f"__{c}") for c in ("of", "n", "quota", "passes", "rest", "cut")]), "plan")

    joined = counted.join(small(cut_plan), F.col(f"`{source}`").eqNullSafe(F.col("__of")))
    key = order_key(F.col(doc_id), F.col("__passes"))
    again = (F.col("__rest") > 0) & (F.col("__cut").isNull() | (key <= F.col("__cut")))
    copies = F.col("__passes") + again.cast("long")
    out = joined.withColumn("__copies", copies).where("__copies > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    place = F.conv(F.substring(order_key(F.col(doc_id), F.col("block")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    length = F.when(F.col("__n") > 0, F.col("__quota") / F.col("__n")).otherwise(1.0)  # of the mixture, in passes over the source
    out = out.withColumn("position", (F.col("block") + place) / length)
    return out.select(*counted.columns, "block", "position"), sources.withColumnRenamed("s", "source")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each copy of a row of `documents` in the mixture: source, doc_id, block, n_tokens and position."""
    mixed, _ = mix(table(spark, sf_dir, "documents"))
    return mixed.select("source", "doc_id", "block", "n_tokens", "position")


OP5_SQL = """
WITH t AS (SELECT doc_id, source, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS n FROM t GROUP BY 1),
m AS (SELECT max(n) AS hi, min(n) FILTER (WHERE n > 0) AS lo FROM s),
x AS (SELECT hi, CASE WHEN hi > lo THEN round(greatest(0, 1 - ln(2.0::DOUBLE) / ln(hi::DOUBLE / lo::DOUBLE)), 6) ELSE 0 END AS e FROM m),
q AS (SELECT source, n, CASE WHEN n > 0 THEN round(hi * pow(n::DOUBLE / hi, e))::BIGINT ELSE 0 END AS quota FROM s, x),
p AS (SELECT source, n, quota, CASE WHEN n > 0 THEN quota // n ELSE 1 END AS passes, CASE WHEN n > 0 THEN quota % n ELSE 0 END AS rest FROM q),
c AS (SELECT t.*, n, quota, passes, rest, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5(doc_id || ':' || passes)) AS upto FROM t JOIN p USING (source)),
b AS (SELECT *, unnest(range(0, passes))::BIGINT AS block FROM c UNION ALL SELECT *, passes::BIGINT FROM c WHERE rest > 0 AND upto <= rest)
SELECT source, doc_id, block, n_tokens::BIGINT AS n_tokens,
 (block + ('0x' || substr(md5(doc_id || ':' || block), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE) / CASE WHEN n > 0 THEN quota::DOUBLE / n ELSE 1.0::DOUBLE END AS position FROM b
"""
