"""Closed frequent itemsets of baskets, found breadth first, and the rules that they give.

A node is a closed set in the making: a closed set (its base) and one more item (its core) that enough of the base's
baskets hold. A level's nodes are a table, their occurrences (node, basket) another. Occurrences are joined to the
baskets' items and counted by (node, item); items that all of a node's baskets hold are absorbed, and a node stays only
if none of those stands before its core without being in the base already (so each closed set comes from one node). Items
after the core that enough, but not all, of the baskets hold make the next level. Each level's tables are written to the
shared folder, which cuts the lineage, and read again.

Baskets of very many items: one basket of n items would give n rows for each of its n items. The few largest baskets are
therefore not expanded. A set that s baskets hold is held by s less their number at least of the others, so the others
alone bring up every set that may count, and those sets are then looked up in the large baskets. How many baskets are set
aside is told by a histogram of basket sizes, never more than half of the least support.

Rows without a basket or an item count nowhere; repeated items of a basket count once. Items are compared as their type
compares. Without a row there is no set. Other columns of the rows, however named, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns, discard, staged

#: A basket of n items gives n * n rows; looking candidates up in it instead costs about so many rows per frequent item.
LOOKED_UP = 16


@dataclass
class Mined:
    """sets: items (ascending), support. single: item, support of each frequent item. baskets: how many there are."""

    sets: DataFrame
    single: DataFrame
    baskets: int
    least: int


def _named(rows: DataFrame, basket: str, item: str) -> DataFrame:
    at = dict(zip(rows.columns, columns(rows)))
    return rows.select(at[basket].alias("basket"), at[item].alias("item")).filter("basket is not null and item is not null")


def _aside(sizes: DataFrame, items: int, least: int) -> int | None:
    """The size beyond which baskets are looked up, not expanded; null if all are expanded."""
    power = F.ceil(F.log2("n"))
    table = sizes.groupBy(power.alias("p")).agg(F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("rows")).collect()
    best, cost = None, sum(r["rows"] for r in table)
    for top in range(4, max((r["p"] for r in table), default=0)):
        beyond = sum(r["k"] for r in table if r["p"] > top)
        if beyond <= least // 2:
            now = sum(r["rows"] for r in table if r["p"] <= top) + LOOKED_UP * items * beyond
            if now < cost:
                best, cost = 1 << top, now
    return best


def _with_large(counts: DataFrame, held: DataFrame | None, large: DataFrame | None, least: int) -> DataFrame:
    """counts (node, item, n) over the expanded baskets, with those of the large ones; the ones below least go.

    held: node, basket of the nodes' large baskets."""
    if large is not None:
        more = counts.join(held, "node").join(large, ["basket", "item"]).select("node", "item", F.lit(1).cast("long").alias("n"))
        counts = counts.unionByName(more).groupBy("node", "item").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least)


def _grow(nodes: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The level's nodes that stay (node, items, core, support), and its children (parent, base, core, support).

    nodes: node, base, core, support; counts: node, item, n of items that at least as many baskets hold as count."""
    all_hold = counts.join(nodes.select("node", "support"), "node").filter("n = support").groupBy("node").agg(F.collect_set("item").alias("full"))
    found = nodes.join(all_hold, "node", "left").withColumn("full", F.coalesce("full", F.array().cast(dict(nodes.dtypes)["base"])))
    early = F.exists("full", lambda x: (x < F.col("core")) & ~F.array_contains("base", x))
    closed = F.sort_array(F.array_union(F.array_union("base", F.array("core")), "full"))
    kept = staged(found.filter(~early).select("node", closed.alias("items"), "core", "support"), "sets-level")
    children = counts.join(kept, "node").filter("item > core and n < support")
    return kept, children.select(F.col("node").alias("parent"), F.col("items").alias("base"), F.col("item").alias("core"), F.col("n").alias("support"))


def _numbered(children: DataFrame) -> DataFrame:
    """Children as a written table, so that their numbers are the same whenever it is read."""
    return staged(children.withColumn("node", F.monotonically_increasing_id()), "sets-nodes")


def closed(rows: DataFrame, basket: str, item: str, least: int = 5, share: int = 20_000) -> Mined:
    """All itemsets that at least `least` baskets and one in `share` baskets hold and no larger set's baskets are the same."""
    given = _named(rows, basket, item)
    kind = f"array<{dict(given.dtypes)['item']}>"
    n_baskets = given.select("basket").distinct().count()
    least = max(least, -(-n_baskets // share))
    entries = staged(given.distinct(), "sets-entries")
    single = staged(entries.groupBy("item").agg(F.count("*").alias("support")).filter(F.col("support") >= least), "sets-single")
    frequent = staged(entries.join(single.select("item"), "item"), "sets-frequent")
    discard(entries)
    sizes = frequent.groupBy("basket").agg(F.count("*").alias("n"))
    most = _aside(sizes, single.count(), least)
    large, aside, some = None, 0, frequent
    if most is not None:
        names = staged(sizes.filter(F.col("n") > most).select("basket"), "sets-names")
        aside = names.count()
        large = staged(frequent.join(names, "basket"), "sets-large")
        some = frequent.join(names, "basket", "left_anti")
    baskets = staged(some.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items")), "sets-baskets")

    # The first level: below the items that all baskets hold, every other frequent item; its baskets are its entries.
    every = single.filter(F.col("support") == n_baskets).groupBy("support").agg(F.sort_array(F.collect_list("item")).alias("base"))
    root = staged(every.select(F.lit(n_baskets).cast("long").alias("all"), "base"), "sets-root")
    first = single.filter(F.col("support") < n_baskets).withColumn("all", F.lit(n_baskets).cast("long")).join(root, "all", "left")
    nodes = _numbered(first.select(F.coalesce("base", F.array().cast(kind)).alias("base"), F.col("item").alias("core"), "support"))
    levels, found = [root], [root.select(F.col("base").alias("items"), F.col("all").alias("support"))]
    pairs = baskets.filter(F.size("items") > 1).select(F.posexplode("items").alias("at", "item"), "items")
    pairs = pairs.select(F.col("item").alias("first"), F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item"))
    pairs = pairs.groupBy("first", "item").agg(F.count("*").alias("n")).filter(F.col("n") >= least - aside)
    numbers = nodes.select("node", F.col("core").alias("first"))
    own = frequent.select(F.col("item").alias("first"), "basket")
    pairs = staged(pairs, "sets-pairs")
    turned = pairs.unionByName(pairs.select(F.col("item").alias("first"), F.col("first").alias("item"), "n"))
    counts = turned.join(numbers, "first").select("node", "item", "n")
    held = large.select(F.col("item").alias("first"), "basket").join(numbers, "first").select("node", "basket") if large is not None else None
    counts = staged(_with_large(counts, held, large, least), "sets-counts")
    discard(pairs)
    occurrences = None
    while True:
        kept, children = _grow(nodes, counts)
        levels.append(kept)
        found.append(kept.select("items", "support"))
        children = _numbered(children)
        discard(counts)
        if children.isEmpty():
            break
        # The children's occurrences: their parents', in baskets that hold the core too.
        cores = children.select("parent", F.col("core").alias("item"), "node")
        if occurrences is None:
            parents = nodes.select(F.col("node").alias("parent"), F.col("core").alias("item"))
            seen = baskets.select("basket", "items", F.explode("items").alias("item")).join(parents, "item").drop("item")
        else:
            seen = occurrences.withColumnRenamed("node", "parent").join(baskets, "basket")
        after = seen.select("parent", "basket", F.explode("items").alias("item"))
        now = staged(after.join(cores, ["parent", "item"]).select("node", "basket"), "sets-occurrences")
        if large is not None:
            held = held.withColumnRenamed("node", "parent").join(cores, "parent").join(large, ["basket", "item"])
            held = staged(held.select("node", "basket"), "sets-held")
        if occurrences is not None:
            discard(occurrences)
        discard(nodes)
        occurrences, nodes = now, children
        counted = occurrences.join(baskets, "basket").select("node", F.explode("items").alias("item")).groupBy("node", "item").agg(F.count("*").alias("n"))
        counts = staged(_with_large(counted.filter(F.col("n") >= least - aside), held, large, least), "sets-counts")
    sets = found[0]
    for level in found[1:]:
        sets = sets.unionByName(level)
    sets = staged(sets, "sets")
    discard(frequent, baskets, *levels)
    return Mined(sets, single, n_baskets, least)


def _key(items: str | Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


def _supports(wanted: DataFrame, mined: Mined) -> DataFrame:
    """rest and a: the support of each set of two items or more that a closed set contains. It is the largest support of
    the closed sets that contain it; most are closed themselves, and the others are looked up under their rarest item."""
    sets = mined.sets
    known = wanted.join(sets.select(F.col("items").alias("rest"), F.col("support").alias("a")), "rest", "left")
    known = staged(known, "sets-rests")
    open_ = known.filter("a is null").select("rest")
    held = sets.filter(F.size("items") > 2).select("items", "support", F.explode("items").alias("item"))
    rare = held.groupBy("item").agg(F.count("*").alias("k"))
    by = open_.select("rest", F.explode("rest").alias("item")).join(rare, "item").groupBy("rest").agg(F.min(F.struct("k", "item")).alias("m"))
    by = by.select("rest", F.col("m.item").alias("item")).join(held, "item").filter(F.size(F.array_except("rest", "items")) == 0)
    return known.filter("a is not null").unionByName(by.groupBy("rest").agg(F.max("support").alias("a")))


def rules(mined: Mined, confidence: int = 60) -> DataFrame:
    """set (its key), c, a, s of each rule: c follows from the other items of a closed set in `confidence` of a hundred of
    the baskets that hold those (a), and more often than in all baskets, of which s hold it."""
    sets = mined.sets.filter(F.size("items") > 1)
    each = sets.select(_key("items").alias("set"), "items", "support", F.explode("items").alias("c"))
    each = each.withColumn("rest", F.array_remove("items", F.col("c"))).drop("items")
    alone = mined.single.select(F.col("item").alias("c"), F.col("support").alias("s"))
    two = each.filter(F.size("rest") == 1).withColumn("other", F.col("rest")[0])
    two = two.join(mined.single.select(F.col("item").alias("other"), F.col("support").alias("a")), "other").drop("other")
    more = staged(each.filter(F.size("rest") > 1), "sets-more")
    more = more.join(_supports(more.select("rest").distinct(), mined), "rest")
    tried = two.unionByName(more).join(alone, "c")
    true = (100 * F.col("support") >= confidence * F.col("a")) & (F.col("support") * mined.baskets > F.col("a") * F.col("s"))
    return tried.filter(true).select("set", "c", "a", "s")


def with_rules(mined: Mined, found: DataFrame) -> DataFrame:
    """items, n_items, support, n_rules, best_item, rules (`c:a:s` in order of c, joined by `;`) of each closed set."""
    told = F.transform(F.sort_array("all"), lambda r: F.concat_ws(":", *(r[x].cast("string") for x in "cas")))
    by = found.groupBy("set").agg(F.collect_list(F.struct("c", "a", "s")).alias("all"), F.min(F.struct("a", "c")).alias("best"))
    by = by.select("set", F.size("all").cast("long").alias("n_rules"), F.col("best.c").alias("best_item"), F.array_join(told, ";").alias("rules"))
    rows = mined.sets.select(_key("items").alias("set"), F.size("items").cast("long").alias("n_items"), "support").join(by, "set", "left")
    return rows.select(F.col("set").alias("items"), "n_items", "support", F.coalesce("n_rules", F.lit(0).cast("long")).alias("n_rules"), "best_item", F.coalesce("rules", F.lit("")).alias("rules"))
