"""Mixing sources to target weights (p9).

Weights are propagated through a tree of domains, languages and sources. A
source that can't reach its share, all its documents used as often as allowed,
leaves a shortage; it goes to siblings with room first, then to the other
languages of the domain, then to the other domains. A source that has documents
in several languages has a leaf in each, by the share of its tokens; so its
documents' own languages make the tree. Each leaf then takes whole epochs of its documents and, of one more epoch in seeded order, the prefix that
comes nearest to its budget.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from peneira.session import staged

# Slices of a source's seeded order: only one slice of each source is looked at document by document.
SLICES = 4096


@dataclass
class Node:
    """A node of the tree: weight is the sum below, room what the leaves below could still take."""

    name: str
    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, "Node"] = field(default_factory=dict)
    budget: float = 0.0

    @property
    def room(self) -> float:
        return sum(c.room for c in self.children.values()) if self.children else max(0.0, self.capacity - self.budget)


def _give(node: Node, amount: float) -> float:
    """Gives a node more, in proportion to the weights of its children as long as they have room; returns what found no room."""
    if not node.children:
        taken = min(amount, node.room)
        node.budget += taken
        return amount - taken
    while amount > 1e-9:
        able = [c for c in node.children.values() if c.room > 1e-9]
        if not able:
            break
        total = sum(c.weight for c in able)
        shares = [amount * (c.weight / total if total > 0 else 1 / len(able)) for c in able]
        amount = sum(_give(c, s) for c, s in zip(able, shares))
    return amount


def budgets(leaves: Sequence[tuple[Sequence[str], float, float, float]]) -> list[float]:
    """Budgets of leaves given as (path from the root, weight, capacity, target).

    Each gets its target as far as its capacity goes. The shortage of a node's
    leaves is settled at the lowest ancestor that has room, the nearer first.
    """
    if not leaves:
        return []
    root, all_leaves = Node("root"), []
    for path, weight, capacity, _ in leaves:
        node = root
        node.weight += weight
        for name in path:
            node = node.children.setdefault(name, Node(name))
            node.weight += weight
        node.capacity += capacity
        all_leaves.append(node)

    def settle(node: Node, targets: dict[int, float]) -> float:
        if not node.children:
            node.budget = min(targets[id(node)], node.capacity)
            return targets[id(node)] - node.budget
        short = sum(settle(c, targets) for c in node.children.values())
        return _give(node, short) if short > 1e-9 else 0.0

    targets: dict[int, float] = {}
    for node, (_, _, _, target) in zip(all_leaves, leaves):
        targets[id(node)] = targets.get(id(node), 0.0) + target
    settle(root, targets)
    return [n.budget for n in all_leaves]


def leaf_report(sized: DataFrame, targets: DataFrame, tree: DataFrame) -> DataFrame:
    """One row per leaf: (source, domain, language, weight, max_repeat, docs, tokens, target, capacity, budget, short).

    sized: (doc_id, tokens, source, lang); targets: (source, weight,
    max_repeat); tree: (source, domain); null parts count as ''. A leaf is a
    source in one language; weight is that of the source, target the leaf's
    part of the source's by its tokens. short: the budgets of all the source's
    leaves, after the tree has settled, stay below the target. The mixture is
    as large as the whole corpus: documents of sources without a target count
    in its size. A source without documents is one leaf without tokens and
    short unless its weight is 0; documents of a null source belong to none.
    Targets repeated for a source count once, the first by weight. The driver
    handles one line for each source of targets and language.
    """
    spark = sized.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.min(F.struct("weight", "max_repeat")).alias("t")).select("source", "t.*")
    places = tree.groupBy("source").agg(F.min(F.coalesce("domain", F.lit(""))).alias("domain"))
    used = staged(sized.groupBy("source", F.coalesce("lang", F.lit("")).alias("language")).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "leaves")
    total = used.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    rows = wanted.join(used, "source", "left").join(places, "source", "left").orderBy("source", "language").collect()
    whole: dict[str, int] = {}
    for r in rows:
        whole[r["source"]] = whole.get(r["source"], 0) + (r["tokens"] or 0)
    leaves = []
    for r in rows:
        tokens, weight = r["tokens"] or 0, r["weight"] or 0.0
        part = tokens / whole[r["source"]] if whole[r["source"]] else 1.0
        leaves.append(((r["domain"] or "", r["language"] or "", r["source"]), weight * part, float(tokens * (r["max_repeat"] or 0)), weight * part * total))
    given = budgets(leaves)
    reached: dict[str, float] = {}
    for r, budget in zip(rows, given):
        reached[r["source"]] = reached.get(r["source"], 0.0) + budget
    out = [
        (r["source"], path[0], path[1], float(r["weight"] or 0), int(r["max_repeat"] or 0), int(r["docs"] or 0), int(r["tokens"] or 0), target, capacity, budget, reached[r["source"]] < (r["weight"] or 0) * total * (1 - 1e-9))
        for r, (path, _, capacity, target), budget in zip(rows, leaves, given)
    ]
    return spark.createDataFrame(out, "source string, domain string, language string, weight double, max_repeat int, docs bigint, tokens bigint, target double, capacity double, budget double, short boolean")


def _order(seed: int, epoch: Column) -> Column:
    """The place of a document in the seeded order of an epoch."""
    return F.xxhash64(F.lit(seed), epoch, F.col("doc_id"), F.col("row"))


def mixture(sized: DataFrame, report: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, times) of the documents used at least once.

    Every document of a leaf is used as often as whole epochs fit the budget;
    of the next epoch, in the order of a seeded hash, those of the prefix whose
    end comes nearest to the budget once more. No document is used more than
    max_repeat times. Prefix sums are taken over slices of the hash first, so
    no source is ordered in one task: document by document only the one slice
    of each leaf is ordered in which its budget ends. Repeated rows are
    documents of their own.
    """
    whole = F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-12).cast("int"), F.col("max_repeat"))
    plan = report.where("tokens > 0").select("source", "language", whole.alias("whole"), F.when(whole < F.col("max_repeat"), F.col("budget") - whole * F.col("tokens")).otherwise(0.0).alias("rest"))
    keys = ["source", "language"]
    numbered = sized.where("tokens > 0").groupBy("doc_id", "source", F.coalesce("lang", F.lit("")).alias("language"), "tokens").agg(F.count("*").alias("copies"))
    docs = numbered.select("doc_id", *keys, "tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("row")).join(plan, keys)
    placed = docs.withColumn("order", _order(seed, F.col("whole"))).withColumn("slice", F.shiftrightunsigned("order", 52).cast("int") % SLICES)
    slices = placed.groupBy(*keys, "slice").agg(F.sum("tokens").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = placed.join(slices.withColumn("start", start), [*keys, "slice"])
    edge = (F.col("start") < F.col("rest")) & (F.col("start") + F.col("n") > F.col("rest"))
    away = known.where(~edge).withColumn("extra", (F.col("start") + F.col("n") <= F.col("rest")).cast("int"))
    end = F.col("start") + F.sum("tokens").over(Window.partitionBy(*keys, "slice").orderBy("order", "doc_id", "row"))
    # A document that crosses the budget is in if that is nearer than to stop before it.
    within = known.where(edge).withColumn("extra", (end - F.col("rest") <= F.col("tokens") / 2).cast("int"))
    every = away.unionByName(within).select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("times"))
    return every.where("times > 0")


def shares(mixed: DataFrame, report: DataFrame) -> DataFrame:
    """(source, weight, reached, used_tokens, largest_times, short) as the mixture reached them."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used"), F.max("times").alias("most"))
    total = mixed.agg(F.sum(F.col("tokens") * F.col("times")).alias("t")).first()["t"] or 0
    told = report.groupBy("source").agg(F.max("weight").alias("weight"), F.bool_or("short").alias("short"))
    got = told.join(used, "source", "left").select("source", "weight", F.coalesce("used", F.lit(0)).alias("used_tokens"), F.coalesce("most", F.lit(0)).alias("largest_times"), "short")
    return got.select("source", "weight", (F.col("used_tokens") / F.lit(max(total, 1))).alias("reached"), "used_tokens", "largest_times", "short")
