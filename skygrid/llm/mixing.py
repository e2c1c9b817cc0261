"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a domain - language - source tree in proportion to the weights of a
node's children. A child that cannot use its share (it holds fewer tokens, epochs counted) gives
the rest to its siblings; only what a whole subtree cannot use reaches the ancestors. Each leaf
then takes whole epochs and, of one more epoch, a prefix in seeded order whose tokens fit.

Everything is SQL. Documents' texts are read, never shuffled: the order within a leaf is cut by a
hash value, found from sums over 4,096 hash ranges and a sort of the one range that holds the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.llm.common import WORD, table

#: Leaves up to which the plan of cuts is broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 20_000
LEVELS = ("domain", "lang", "source")
#: Names that rows carry here beside the documents' own columns.
_OWN = ("_mix_domain", "_mix_lang", "_mix_source")


def default_domain(source: Column) -> Column:
    """Two domains by the first hexadecimal digit of the source's md5."""
    return F.when(F.md5(F.coalesce(source, F.lit("")).cast("binary")) < "8", F.lit("a")).otherwise(F.lit("b"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        if w < 0 or w != int(w):
            raise ValueError(f"weight of {level} {name!r} must be a whole number from 0: {w}")
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's ``budget`` among children (columns cap, weight above 0, name): alloc = min(cap, level * weight).

    The level is where the allocations use up the budget: children in order of cap / weight fill up
    until the even share of what is left no longer reaches the next one.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")).asc(), F.col(name).asc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    tried = (
        children.withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("_left", F.sum("weight").over(after))
        .withColumn("_level", (F.col("budget") - F.col("_used")) / F.col("_left"))
    )
    open_level = F.when(F.col("cap") / F.col("weight") > F.col("_level"), F.col("_level"))
    level = F.max(open_level).over(Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0)))
    alloc = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(level * F.col("weight"))))
    return tried.withColumn("alloc", F.greatest(alloc, F.lit(0)).cast("long")).drop("_used", "_left", "_level")


def _keys(docs: DataFrame, domain) -> DataFrame:
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    return docs.withColumns(dict(zip(_OWN, (domain(text("source")), text("lang"), text("source")), strict=True)))


def budgets(sizes: DataFrame, weights: dict, budget: float, epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with their token budget; one under a name of weight 0 is shut.

    A shut leaf adds nothing to what its ancestors can use, so its share goes to siblings first.
    """
    shut = F.lit(False)
    for level in LEVELS:
        shut = shut | (_weight(level, weights) == 0)
    leaves = sizes.withColumn("cap", F.col("tokens") * epochs).withColumn("shut", shut)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * budget).cast("long").alias("budget"))
    usable = leaves.where("not shut")
    held = [usable.groupBy(*LEVELS[: i + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(LEVELS[i], weights)) for i in range(3)]
    level = share_out(held[0].crossJoin(F.broadcast(total)), [], "domain")
    for i in (1, 2):
        above = level.select(*LEVELS[:i], F.col("alloc").alias("budget"))
        level = share_out(held[i].join(above, list(LEVELS[:i])), list(LEVELS[:i]), LEVELS[i])
    return leaves.select(*LEVELS, "tokens", "shut").join(level.select(*LEVELS, F.col("alloc").alias("budget")), list(LEVELS), "left").na.fill(0, ["budget"])


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], budget: float, epochs: int = 1, seed: int = 1, domain=default_domain, names: tuple[str, str] = ("domain", "epoch")) -> DataFrame:
    """docs in the mixture, with domain and epoch (from 1, up to ``epochs``): a document chosen in two epochs is two rows.

    ``budget`` is a share of all tokens. ``weights`` maps a level (domain, lang, source) to whole
    numbers, 1 where not named; a node of weight 0 is left out, its share goes to its siblings. Null
    lang or source counts as ''. A document without tokens costs nothing: it stays where the prefix
    reaches it, but in no epoch after the last. Of a leaf with a budget of 0 only documents of a
    leaf without any tokens stay. Rows that repeat a doc_id share its place. ``names`` call the two
    new columns; an input column of that name is replaced, all others are kept. An empty table gives
    an empty one.
    """
    keyed = _keys(docs, domain)
    slim = table(keyed.select("doc_id", *(F.col(c).alias(a) for c, a in zip(_OWN, LEVELS, strict=True)), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens")))
    sizes = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(sizes, weights, budget, epochs)
    plan = table(plan.withColumn("full", F.least(F.coalesce(F.floor(F.try_divide("budget", "tokens")), F.lit(0)), F.lit(epochs)).cast("int")).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")))
    small = plan.count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda x: x)
    place = lambda key, epoch: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    placed = slim.join(hint(plan.drop("tokens", "budget", "shut")), list(LEVELS)).withColumn("_at", place(F.col("doc_id"), F.col("full") + 1)).withColumn("_range", F.substring("_at", 1, 3))
    run = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*LEVELS, "_range", "rest").agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(run))
    edge = sums.where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("_range", (F.col("upto") - F.col("t")).alias("base"))).alias("e")).select(*LEVELS, F.col("e._range").alias("_range"), F.col("e.base").alias("base"))
    within = placed.join(hint(edge), [*LEVELS, "_range"]).groupBy(*LEVELS, "_range", "base", "rest", "_at").agg(F.sum("tokens").alias("t"))
    fit = within.withColumn("upto", F.col("base") + F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    last = fit.where("upto <= rest").groupBy(*LEVELS).agg(F.max("_at").alias("_last"))
    cut = F.when((F.col("budget") == 0) & ((F.col("tokens") > 0) | F.col("shut")), "").otherwise(F.coalesce("_last", "_range", F.lit("g")))
    cuts = plan.join(edge, list(LEVELS), "left").join(last, list(LEVELS), "left").select(*(F.col(c).alias(a) for c, a in zip(LEVELS, _OWN, strict=True)), F.col("full").alias("_mix_full"), cut.alias("_mix_cut"))
    cuts = table(cuts)
    out = keyed.join(hint(cuts), list(_OWN)).withColumn("_mix_epoch", F.explode(F.sequence(F.lit(1), F.least(F.col("_mix_full") + 1, F.lit(epochs)))))
    out = out.where((F.col("_mix_epoch") <= F.col("_mix_full")) | (place(docs["doc_id"], F.col("_mix_epoch")) <= F.col("_mix_cut")))
    kept = [docs[c] for c in docs.columns if c not in names]
    return out.select(*kept, F.col("_mix_domain").alias(names[0]), F.col("_mix_epoch").alias(names[1]))
