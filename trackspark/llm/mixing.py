"""Mixing sources to target weights over a domain-language-source tree.

Budgets go down the tree level by level: siblings share their parent's budget by weight, none above its capacity
(the tokens below it times the allowed epochs). What a full node cannot take goes to its siblings first; only if all
of them are full does the parent's own capacity bind, and the rest moves on among the parent's siblings. One pass over
siblings sorted by capacity per weight finds the level, so there is no iteration.

Each leaf then takes whole epochs and, of its last epoch, the longest prefix in that epoch's seeded order which stays
within the budget. Prefix sums run per (leaf, slice of the order); only sums per slice are chained, so one leaf may
hold any share of the rows.

Defined cases: null levels count as ''. A null or empty text has no tokens and takes no budget. Identical rows
(doc_id, text, levels) are one unit that is taken or left as a whole. Weight 0 takes nothing, a missing weight is 1.
An empty table gives an empty result. Only columns named here are read; others may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.llm.text import WORD, packed
from trackspark.scale import running_sum
from trackspark.session import cut_lineage

LEVELS = ("domain", "lang", "source")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(seed: int, epoch: Column, doc: Column) -> Column:
    """Place of a document in the seeded order of one epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))))


def _units(docs: DataFrame, domain: Column) -> DataFrame:
    """One row per distinct (doc, text, levels) with its tokens."""
    levels = [F.coalesce(c, F.lit("")).alias(n) for n, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")))]
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), *levels, count_words(F.col("text")).alias("tokens"))
    return cut_lineage(rows.groupBy("doc", "th", *LEVELS).agg(F.sum("tokens").alias("tokens")))


def _weight(weights: Mapping[str, int], depth: int) -> Column:
    """Weight of a node by its path, e.g. 'web/en/src0'; 1 if none is given."""
    named = {k: v for k, v in weights.items() if k.count("/") == depth}
    path = F.concat_ws("/", *LEVELS[: depth + 1])
    if not named:
        return F.lit(1).cast("bigint")
    table = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), F.lit(int(v)).cast("bigint"))])
    return F.coalesce(F.try_element_at(table, path), F.lit(1).cast("bigint"))


def _share(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Adds ``allot``: the parent's ``budget`` by ``weight``, none above ``cap``; whole tokens, nothing lost."""
    wide = lambda c, p: F.expr(f"cast({c} as decimal({p},0))")
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight")).otherwise(0.0)
    ordered = by.orderBy(ratio, name)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = nodes.withColumns({
        "caps": F.sum("cap").over(upto) - F.col("cap"),
        "ahead": F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    level = level.withColumn("fits", (wide("cap", 20) * wide("ahead", 17) <= wide("budget - caps", 20) * wide("weight", 17)).cast("int"))
    level = level.withColumn("full", F.min("fits").over(upto))
    level = level.withColumns({
        "rest": F.col("budget") - F.sum(F.when(F.col("full") == 1, F.col("cap")).otherwise(0)).over(by),
        "open": F.when(F.col("full") == 0, F.col("weight")).otherwise(0),
    })
    level = level.withColumns({
        "upto": F.sum("open").over(by.orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "all": F.greatest(F.sum("open").over(by), F.lit(1)),
    })
    part = "cast({rest} as decimal(20,0)) * cast({w} as decimal(17,0)) div cast(`all` as decimal(17,0))"
    rounded = F.expr(part.format(rest="rest", w="upto")) - F.expr(part.format(rest="rest", w="(upto - open)"))
    level = level.withColumn("allot", F.when(F.col("full") == 1, F.col("cap")).otherwise(rounded).cast("bigint"))
    return level.select(*nodes.columns, "allot")


def leaf_budgets(units: DataFrame, weights: Mapping[str, int], budget: int | None, share: float, max_epochs: int) -> DataFrame:
    """``domain, lang, source, have, allot`` per leaf; the root's budget is ``budget`` or ``share`` of all tokens."""
    leaves = cut_lineage(units.groupBy(*LEVELS).agg(F.sum("tokens").alias("have")))
    total = leaves.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("n")).first()["n"]
    wanted = int(total * share) if budget is None else int(budget)
    tree = leaves.withColumn("w3", _weight(weights, 2)).withColumn("w2", _weight(weights, 1)).withColumn("w1", _weight(weights, 0))
    tree = tree.withColumn("c3", F.when(F.col("w3") > 0, F.col("have") * max_epochs).otherwise(0))
    two = tree.groupBy("domain", "lang", "w2", "w1").agg(F.sum("c3").alias("cap"))
    two = two.withColumn("cap", F.when(F.col("w2") > 0, F.col("cap")).otherwise(0))
    one = two.groupBy("domain", "w1").agg(F.sum("cap").alias("cap"))
    one = one.select("domain", F.col("w1").alias("weight"), F.when(F.col("w1") > 0, F.col("cap")).otherwise(0).alias("cap"))
    roof = F.least(F.lit(wanted).cast("bigint"), F.sum("cap").over(Window.partitionBy(F.lit(0))))
    got = _share(one.withColumn("budget", roof), [], "domain").select("domain", F.col("allot").alias("budget"))
    langs = two.select("domain", "lang", F.col("w2").alias("weight"), "cap").join(got, "domain")
    got = _share(langs, ["domain"], "lang").select("domain", "lang", F.col("allot").alias("budget"))
    leaf = tree.select(*LEVELS, "have", F.col("w3").alias("weight"), F.col("c3").alias("cap")).join(got, ["domain", "lang"])
    return _share(leaf, ["domain", "lang"], "source").select(*LEVELS, "have", "allot")


def mix(
    docs: DataFrame, domain: Column, weights: Mapping[str, int], budget: int | None = None, share: float = 1.0,
    max_epochs: int = 1, seed: int = 17,
) -> DataFrame:
    """``doc, th, domain, lang, source, epoch, tokens``: one row per taken unit and epoch."""
    units = _units(docs, domain)
    leaves = cut_lineage(leaf_budgets(units, weights, budget, share, max_epochs))
    leaves = leaves.filter((F.col("allot") > 0) & (F.col("have") > 0))
    leaves = leaves.select(*LEVELS, F.expr("allot div have").alias("whole"), (F.col("allot") % F.col("have")).alias("left"))
    placed = units.join(leaves, list(LEVELS))
    whole = placed.filter(F.col("whole") > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("epoch"))
    last = placed.filter(F.col("left") > 0).withColumn("epoch", F.col("whole"))
    last = last.withColumn("key", order_key(seed, F.col("epoch"), F.col("doc")))
    last = last.withColumn("slice", F.conv(F.substring("key", 1, 4), 16, 10).cast("int"))
    summed = running_sum(last, list(LEVELS), ["key", "th"], "slice", F.col("tokens"), "upto")
    columns = ["doc", "th", *LEVELS, "epoch", "tokens"]
    return whole.select(*columns).union(summed.filter(F.col("upto") <= F.col("left")).select(*columns))


def taken_rows(docs: DataFrame, picks: DataFrame, domain: Column) -> DataFrame:
    """The input's rows and columns, once for each epoch they were taken in."""
    rows = packed(docs.withColumn("__domain", F.coalesce(domain, F.lit(""))))
    picks = picks.select(*[F.col(c).alias(f"p_{c}") for c in ("doc", "th", *LEVELS)])
    same = F.col("row.doc_id").eqNullSafe(F.col("p_doc")) & (F.xxhash64("row.text") == F.col("p_th"))
    same = same & (F.col("row.__domain") == F.col("p_domain"))
    for level in LEVELS[1:]:
        same = same & (F.coalesce(F.col(f"row.{level}"), F.lit("")) == F.col(f"p_{level}"))
    return rows.join(picks, same).select("row.*").drop("__domain")
