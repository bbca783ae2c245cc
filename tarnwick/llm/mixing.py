"""Mixing sources to target weights: budgets down a tree, then token prefixes of seeded epochs.

Budgets go from the root to domains, languages and sources by weight. A node takes at most what
its leaves hold times `epochs`; what it cannot take goes to its siblings by weight, and only
when a whole family is full to the families of its ancestors. (Filling each family level by
level, with the capacities of whole subtrees, does just that.) A leaf's budget is spent on whole
epochs first, then on the prefix of one more epoch, whose order is a hash of seed, epoch and
document: the documents up to the last that fits whole.

The prefix of a leaf is found from sums per hash range (4096 of them, summed map-side); only
the one range in which the budget ends is sorted, so a leaf with a third of all rows is no
burden. DataFrame operations only.

Defined cases: null path columns are nodes named ''; a null text has no tokens; a document
without tokens costs nothing and is taken with its epoch's prefix; a family whose weights are
all 0 takes nothing; rows with equal doc_id and text tie and are taken together or not;
very long texts are counted whole; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.session import materialise

LEVELS = ("domain", "lang", "source")
RANGE_DIGITS = 3  # hex digits of the order hash that name a range
SALTS = 32


def fill(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """A further column `given` for nodes (…family, name, weight, cap, budget of the family).

    Children in order of cap / weight: one is full if all before it are and the level at which
    it fills still fits the budget; the rest share what is left by weight.
    """
    order = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    w = W.partitionBy(*family) if family else W.partitionBy(F.lit(0))
    before = w.orderBy("_r", name).rowsBetween(W.unboundedPreceding, -1)
    df = nodes.withColumn("_r", order)
    df = df.withColumn("_caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    df = df.withColumn("_rest", F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("_full", F.coalesce((F.col("_caps") + F.col("_r") * F.col("_rest")) <= F.col("budget"), F.lit(False)))
    spent = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0.0)).over(w)
    open_weight = F.sum(F.when(F.col("_full") | (F.col("weight") <= 0), 0.0).otherwise(F.col("weight"))).over(w)
    df = df.withColumn("_spent", spent).withColumn("_open", open_weight)
    share = F.when(F.col("_open") > 0, (F.col("budget") - F.col("_spent")) * F.col("weight") / F.col("_open")).otherwise(0.0)
    given = F.when(F.col("_full"), F.col("cap")).when(F.col("weight") > 0, F.least("cap", share)).otherwise(0.0)
    return df.withColumn("given", given).drop("_r", "_caps", "_rest", "_full", "_spent", "_open")


def budgets(leaves: DataFrame, budget: float, epochs: int, power: float = 0.7, weights: DataFrame | None = None) -> DataFrame:
    """(domain, lang, source, tokens, budget) for leaves (domain, lang, source, tokens).

    A node's weight is its row in weights (domain, lang, source, weight; null below its level),
    or else its tokens to the given power.
    """
    levels, below = [], leaves.groupBy(*LEVELS).agg(F.sum("tokens").cast("double").alias("tokens")).withColumn("cap", F.col("tokens") * epochs)
    for depth in range(len(LEVELS), 0, -1):
        path = list(LEVELS[:depth])
        nodes = below.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap")).withColumn("weight", F.pow("tokens", F.lit(power)))
        if weights is not None:
            level = weights.where(" AND ".join([f"{c} IS NOT NULL" for c in path] + [f"{c} IS NULL" for c in LEVELS[depth:]]))
            nodes = nodes.join(level.select(*path, F.col("weight").cast("double").alias("_own")), path, "left")
            nodes = nodes.withColumn("weight", F.coalesce("_own", "weight")).drop("_own")
        # What has no weight takes nothing, so it is no room that its ancestors have.
        below = nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0))
        levels.insert(0, below)
    above, family = leaves.limit(0), []
    for depth, (name, nodes) in enumerate(zip(LEVELS, levels, strict=True), 1):
        path = list(LEVELS[:depth])
        nodes = nodes.withColumn("budget", F.lit(float(budget))) if not family else nodes.join(above.drop("tokens"), family)
        above = fill(nodes, family, name).select(*path, "tokens", F.col("given").alias("budget"))
        family = path
    return above


def mix(docs: DataFrame, n_tokens: Column, domain: Column, share: float = 1.0, epochs: int = 2, power: float = 0.7, seed: int = 17, weights: DataFrame | None = None) -> DataFrame:
    """docs with domain, n_tokens and epochs, how often each row is taken (0: not).

    The whole budget is `share` of all tokens. Columns of docs with these names are replaced.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "domain", "n_tokens", "epochs")]
    packed = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0).alias("none"))
    docs = docs.select("doc_id", "text", *(c.alias(p) for c, p in zip((domain, F.col("lang"), F.col("source"), n_tokens), ("_0", "_1", "_2", "_3"), strict=True)), packed.alias("_rest"))
    domain, n_tokens = F.col("_0"), F.col("_3")
    path = [f"_{c}" for c in LEVELS]
    at = [F.coalesce(c, F.lit("")) for c in (domain, F.col("_1"), F.col("_2"))]
    docs = docs.withColumns(dict(zip(path, at, strict=True)))
    # What decides is a few numbers for each row, so texts are read once for them and once for the result.
    slim = materialise(docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("_tie"), *path, n_tokens.cast("long").alias("n")), "slim")
    leaves = slim.groupBy(*(F.col(p).alias(c) for p, c in zip(path, LEVELS, strict=True))).agg(F.sum("n").alias("tokens"))
    total = slim.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    given = budgets(leaves, total * share, epochs, power, weights)
    # floor: a budget is never overdrawn by rounding
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-12)).otherwise(0)
    given = given.withColumn("whole", whole.cast("long")).withColumn("rest", F.floor(F.col("budget") - F.col("whole") * F.col("tokens") + 1e-6).cast("long"))
    given = materialise(given.select(*(F.col(c).alias(p) for c, p in zip(LEVELS, path, strict=True)), "whole", "rest"), "leaves")

    def order(tie: Column) -> Column:
        """The place of a row in its leaf's epoch: a seeded hash, then the text's."""
        name = F.concat_ws("/", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        return F.concat(F.md5(name), tie)

    # One row per leaf, repeated for each salt, so that a hot leaf's rows are dealt to many tasks.
    salted = given.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = slim.withColumn("_salt", F.pmod(F.hash("doc_id", "_tie"), F.lit(SALTS))).join(salted, [*path, "_salt"]).drop("_salt")
    rows = rows.withColumn("_key", order(F.col("_tie"))).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    sums = rows.groupBy(*path, "rest", "_range").agg(F.sum("n").alias("_sum"))
    upto = F.sum("_sum").over(W.partitionBy(*path).orderBy("_range").rowsBetween(W.unboundedPreceding, 0))
    edge = sums.withColumn("_upto", upto).where((F.col("_upto") > F.col("rest")) & (F.col("_upto") - F.col("_sum") <= F.col("rest")))
    edge = edge.select(*path, "_range", (F.col("_upto") - F.col("_sum")).alias("_from"))
    inside = rows.join(edge, [*path, "_range"])
    until = F.col("_from") + F.sum("n").over(W.partitionBy(*path, "_range").orderBy("_key").rangeBetween(W.unboundedPreceding, 0))
    # The first place that is not taken; none where all are.
    cut = inside.withColumn("_until", until).where("_until > rest").groupBy(*path).agg(F.min("_key").alias("_cut"))
    ends = materialise(given.join(cut, path, "left").select(*path, "whole", "_cut"), "ends")
    # A row per leaf, of a size that Spark knows: it is broadcast if small, else joined by shuffle.
    out = docs.join(ends, path).withColumn("_key", order(F.md5(F.coalesce("text", F.lit("")))))
    taken = F.col("whole") + F.when(F.coalesce(F.col("_key") < F.col("_cut"), F.lit(True)), 1).otherwise(0)
    return out.select("doc_id", "text", *(F.col("_rest").getField(c).alias(c) for c in rest), F.col("_domain").alias("domain"), n_tokens.cast("long").alias("n_tokens"), taken.cast("int").alias("epochs"))
