"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Sources sit in a tree domain -> language -> source.  A token budget is handed
down the tree in proportion to weights.  A node never takes more than its
supply, which is its leaves' tokens times ``max_epochs``; what it cannot take
goes to its siblings by their weights, and only what all of them cannot take
goes back to the level above.  All budgets are whole numbers, and every step
is exact: a level is one pass of window sums over the node table, children in
the order of supply per weight.

A leaf with budget b and t tokens takes every document b div t times, and the
documents of one more epoch, in the seeded order of that epoch, up to the
longest prefix of at most b mod t tokens.

Documents meet windows only where a prefix ends: token sums are taken per
(leaf, first characters of the order key), and only documents of the one slot
in which the prefix ends are ordered one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecast.llm.store import keep, word_count

LEVELS = ("domain", "lang", "source")
SLOT_CHARS = 3  # hex digits of the order key that name a slot: 4096 slots a leaf


@dataclass
class Plan:
    """What to mix.

    ``numerator / denominator`` of all tokens is the budget.  ``domains`` maps
    a regular expression on the source to a domain, first match wins; other
    sources fall in ``other``.  ``domain_weights`` and ``lang_weights`` hold whole
    numbers by name, 1 where absent; sources of one language weigh the same.
    """

    numerator: int = 4
    denominator: int = 5
    max_epochs: int = 3
    seed: int = 17
    domains: list = field(default_factory=list)
    domain_weights: dict = field(default_factory=dict)
    lang_weights: dict = field(default_factory=dict)


def _weight(column: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.items(), reverse=True):
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _domain(source: Column, domains: list) -> Column:
    out = F.lit("other")
    for pattern, name in reversed(domains):
        out = F.when(source.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def water_fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's ``budget`` among its children by ``weight``, none above its ``supply``.

    With the children in the order of supply per weight, one is full if it
    fits into the share left by those before it; from the first that is not,
    all share the rest by weight, rounded down.  Adds ``given``.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("supply").cast("double") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = (children.withColumn("budget_left", F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0)))
            .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    judged = left.withColumn("full", F.col("supply") * F.col("weight_left") <= F.col("weight") * F.col("budget_left"))
    first = lambda c: F.max(F.when(~F.col("full"), F.col(c))).over(whole)
    levelled = judged.withColumn("rest", first("budget_left")).withColumn("shares", first("weight_left"))
    return levelled.withColumn("given", F.when(F.col("full"), F.col("supply")).otherwise(
        F.expr("(weight * rest) div shares"))).drop("budget_left", "weight_left", "full", "rest", "shares")


def leaf_budgets(tokens: DataFrame, plan: Plan) -> DataFrame:
    """Rows ``(domain, lang, source, tokens, budget)`` of ``tokens(domain, lang, source, n_tokens)``."""
    leaves = (tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
              .withColumn("supply", F.col("tokens") * plan.max_epochs))
    leaves = keep(leaves, "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    nodes = leaves.groupBy("domain").agg(F.sum("supply").alias("supply")).withColumn("weight", _weight("domain", plan.domain_weights))
    nodes = water_fill(nodes.withColumn("budget", F.lit(total * plan.numerator // plan.denominator)).withColumn("top", F.lit(0)), ["top"], "domain")
    below = leaves.groupBy("domain", "lang").agg(F.sum("supply").alias("supply")).withColumn("weight", _weight("lang", plan.lang_weights))
    below = water_fill(below.join(nodes.select("domain", F.col("given").alias("budget")), "domain"), ["domain"], "lang")
    last = leaves.withColumn("weight", F.lit(1).cast("long")).join(
        below.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"])
    return water_fill(last, ["domain", "lang"], "source").select(*LEVELS, "tokens", F.col("given").alias("budget"))


def mix(docs: DataFrame, plan: Plan, out: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``out``: domain, lang, source, n_tokens, leaf_tokens, leaf_budget, copies.

    ``copies`` is how often the document is taken, 0 included.  Tokens are
    words.  A null language or source is the value ``none``.  Rows whose order
    keys tie (repeated rows, null ids) are taken together or not at all.  A
    leaf without tokens gets no budget and its documents no copy.  Weights are
    positive and sum to at most 10,000 among siblings, tokens to 10**14; more
    overflows loudly under ANSI mode.  An empty table stays empty.
    """
    named = docs.select(
        *docs.columns, F.struct(
            _domain(F.coalesce(F.col("source").cast("string"), F.lit("none")), plan.domains).alias("domain"),
            F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"),
            F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("source"),
            word_count("text").alias("n_tokens")).alias("__leaf"))
    order_key = lambda epochs: F.md5(F.concat_ws(":", F.lit(plan.seed), epochs, F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    tokens = keep(named.select("doc_id", "__leaf.*"), "tokens")
    budgets = leaf_budgets(tokens, plan)
    budgets = keep(budgets.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0))
                   .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0)), "budgets")
    slot = lambda key: F.substring(key, 1, SLOT_CHARS)
    slots = (tokens.join(budgets, [*LEVELS]).withColumn("slot", slot(order_key(F.col("epochs"))))
             .groupBy(*LEVELS, "slot", "rest").agg(F.sum("n_tokens").alias("in_slot")))
    run = F.sum("in_slot").over(Window.partitionBy(*LEVELS).orderBy("slot"))
    edges = (slots.withColumn("run", run).where("run > rest").groupBy(*LEVELS)
             .agg(F.min(F.struct("slot", (F.col("run") - F.col("in_slot")).alias("before"))).alias("edge")))
    leaf = keep(budgets.join(edges, [*LEVELS], "left"), "leaf")
    leaf = leaf.select(*[F.col(c).alias(f"__{c}") for c in leaf.columns])
    placed = (named.join(leaf, (F.col("__leaf.domain") == F.col("__domain")) & (F.col("__leaf.lang") == F.col("__lang"))
                         & (F.col("__leaf.source") == F.col("__source")))
              .withColumn("__key", order_key(F.col("__epochs"))).withColumn("__slot", slot(F.col("__key"))))
    at_edge = F.coalesce(F.col("__slot") == F.col("__edge.slot"), F.lit(False))
    in_order = Window.partitionBy("__domain", "__lang", "__source").orderBy("__key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    one_by_one = (placed.where(at_edge).withColumn("__run", F.sum("__leaf.n_tokens").over(in_order))
                  .withColumn("__more", (F.col("__edge.before") + F.col("__run") <= F.col("__rest")).cast("int")).drop("__run"))
    at_once = placed.where(~at_edge).withColumn("__more", F.coalesce((F.col("__slot") < F.col("__edge.slot")).cast("int"), F.lit(0)))
    return at_once.unionByName(one_by_one).select(*docs.columns, F.struct(
        "__leaf.*", F.col("__tokens").alias("leaf_tokens"), F.col("__budget").alias("leaf_budget"),
        (F.col("__epochs") + F.col("__more")).cast("long").alias("copies")).alias(out))


def take_mixed(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` as mixed: every document as often as ``mix`` takes it, columns unchanged."""
    mixed = mix(docs, plan, "__mix").where("__mix.copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix.copies")))).select(*docs.columns)
