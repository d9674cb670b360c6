"""Mixing sources to target weights over a domain - language - source tree.

Budgets go down the tree by weight. A node takes no more than its documents give within ``max_epochs`` epochs; what it can't
take goes to its siblings by their weights, and only what all siblings together can't take goes back to the ancestors'
siblings: each level is a capped water filling with the capacities of whole subtrees. A leaf then takes whole epochs and a
token prefix of one more epoch in an order seeded by the epoch. The prefix is found as a cut key, so texts are never moved.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.llm.common import materialise

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: Leaves that a plan may have to be broadcast; beyond it the plan is joined by shuffle.
BROADCAST_LEAVES = 50_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; none for a null text."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != "")), F.lit(0)).cast("long")


def fill(nodes: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Column ``budget``: what each node gets of ``parent_budget``, by ``weight`` and capped by ``capacity``.

    Siblings together get the whole parent budget, or all that they can take. Shares are cut down to whole tokens; those left
    over go one by one to the nodes with the largest fractions that still have room, ties to the smaller name.
    """
    among = Window.partitionBy(*parent)
    order = among.orderBy(F.col("ratio"), F.col(node))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = lambda c: c.cast("decimal(38,0)")
    share = whole(F.col("level.left")) * F.col("weight")
    return (
        nodes.withColumn("weight", F.greatest(F.col("weight"), F.lit(0)))
        .withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("left", F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(among) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("open", (F.col("weight") > 0) & (whole(F.col("left")) * F.col("weight") <= whole(F.col("capacity")) * F.col("rest")))
        .withColumn("level", F.first(F.when(F.col("open"), F.struct("left", "rest")), ignorenulls=True).over(everything))
        .withColumn("share", F.when(F.col("level").isNull() | (share >= whole(F.col("capacity")) * F.col("level.rest")), F.col("capacity")).otherwise(F.floor(share / F.col("level.rest"))).cast("long"))
        .withColumn("share", F.when(F.col("weight") > 0, F.col("share")).otherwise(F.lit(0)))
        .withColumn("fraction", F.when((F.col("weight") > 0) & (F.col("share") < F.col("capacity")), share - whole(F.col("share")) * F.col("level.rest")).otherwise(F.lit(0)))
        .withColumn("over", F.when(F.col("level").isNull(), F.lit(0)).otherwise(F.col("parent_budget") - F.sum("share").over(among)))
        .withColumn("place", F.row_number().over(among.orderBy(F.desc("fraction"), F.col(node))))
        .withColumn("budget", (F.col("share") + ((F.col("fraction") > 0) & (F.col("place") <= F.col("over"))).cast("long")).cast("long"))
        .drop("ratio", "left", "rest", "open", "level", "share", "fraction", "over", "place")
    )


def allocate(leaves: DataFrame, weights: DataFrame, budget: Column, levels: tuple[str, ...], max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with each leaf's ``budget``. ``weights`` has (path, weight), path joined by '/'; else 1.

    A node's capacity is that of the leaves below it that no weight of zero or less shuts off, so what a shut branch can't
    take goes to its siblings. The leaves' budgets sum to ``budget``, or to all open leaves' capacity. Weights count to six
    decimals.
    """
    keys = list(levels)
    weights = weights.select("path", (F.col("weight").cast("decimal(18,6)") * 1_000_000).cast("long").alias("weight"))
    nodes = leaves
    for depth, level in enumerate(levels, 1):
        here = F.coalesce(F.col(f"__w{depth}"), F.lit(1_000_000))
        nodes = nodes.withColumn("path", F.concat_ws("/", *keys[:depth])).join(weights.withColumnRenamed("weight", f"__w{depth}"), "path", "left").drop("path").withColumn(f"__w{depth}", here)
    alive = F.least(*[F.col(f"__w{d}") for d in range(1, len(keys) + 1)], F.lit(1_000_000)) > 0
    nodes = nodes.withColumn("capacity", F.when(alive, F.col("tokens") * max_epochs).otherwise(F.lit(0)))
    above = nodes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens")).select(F.greatest(budget.cast("long"), F.lit(0)).alias("budget"), F.lit(0).alias("root"))
    for depth, level in enumerate(levels, 1):
        up, here = keys[: depth - 1] or ["root"], keys[:depth]
        at = nodes.withColumn("root", F.lit(0)).groupBy(*dict.fromkeys([*up, *here])).agg(F.sum("capacity").alias("capacity"), F.first(f"__w{depth}").alias("weight"))
        above = fill(at.join(above.withColumnRenamed("budget", "parent_budget"), up), up, level).select(*here, "budget")
    return leaves.join(above, keys)


def _key(seed: int, epoch: Column, identity: Column) -> Column:
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), identity).cast("binary")), F.lit(":"), identity)


def _identity(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def _small(df: DataFrame, limit: int = BROADCAST_LEAVES) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def plan(docs: DataFrame, weights: DataFrame, levels: tuple[str, ...] = LEVELS, budget: Column | None = None, max_epochs: int = 4, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each leaf: levels, tokens, budget, epochs (whole ones) and cut_key (last key of the prefix, or null).

    Null levels count as '(none)'. Rows of one leaf with the same id stand together. A leaf without tokens has budget 0 and
    keeps nothing. ``budget`` is a column over ``all_tokens``, the tokens of all documents; default: all of them.
    """
    budget = F.col("all_tokens") if budget is None else budget
    keys = list(levels)
    narrow = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in levels], _identity(id_col).alias("__identity"), word_count(F.col(text_col).cast("string")).alias("__tokens"))
    narrow = materialise(narrow, "mix-tokens")
    leaves = narrow.groupBy(*keys).agg(F.sum("__tokens").alias("tokens"))
    leaves = materialise(allocate(leaves, weights, budget, levels, max_epochs).withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int")), "mix-leaves")
    left = leaves.select(*keys, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("left"), F.lit("").alias("head")).where("left > 0")
    for digits in (2, 4):  # the bucket of keys that holds the end of the prefix: 256 buckets in a leaf, then 256 in that
        inside = narrow.join(_small(left), keys).withColumn("key", _key(seed, F.col("epochs"), F.col("__identity"))).where(F.col("key").startswith(F.col("head")))
        buckets = inside.groupBy(*keys, "epochs", "left", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("__tokens").alias("sum"))
        along = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.withColumn("before", F.coalesce(F.sum("sum").over(along), F.lit(0))).where("before < left and before + sum >= left")
        left = materialise(buckets.select(*keys, "epochs", (F.col("left") - F.col("before")).alias("left"), F.col("bucket").alias("head")), "mix-bucket")
    inside = narrow.join(_small(left), keys).withColumn("key", _key(seed, F.col("epochs"), F.col("__identity"))).where(F.col("key").startswith(F.col("head")))
    along = Window.partitionBy(*keys, "head").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cuts = inside.groupBy(*keys, "head", "left", "key").agg(F.sum("__tokens").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(along), F.lit(0))).where("before < left").groupBy(*keys).agg(F.max("key").alias("cut_key"))
    return leaves.join(cuts, keys, "left")


def mix(docs: DataFrame, leaf_plan: DataFrame, levels: tuple[str, ...] = LEVELS, seed: int = 7, id_col: str = "doc_id", copies: str = "copies") -> DataFrame:
    """``docs`` with ``copies``: in how many epochs of the mixture each row stands (0: in none). All columns are kept.

    The plan's columns get names that nothing else has before the join, so documents may have columns of any name; one named as
    ``copies`` is replaced.
    """
    tag = uuid.uuid4().hex
    epochs, cut = f"epochs_{tag}", f"cut_{tag}"
    leaf = leaf_plan.select(*[F.col(c).alias(f"{c}_{tag}") for c in levels], F.col("epochs").alias(epochs), F.col("cut_key").alias(cut))
    on = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)) == F.col(f"{c}_{tag}") for c in levels]
    extra = F.when(_key(seed, F.col(epochs), _identity(id_col)) <= F.col(cut), 1).otherwise(0)
    return docs.join(_small(materialise(leaf, "mix-plan")), on, "left").withColumn(copies, (F.coalesce(epochs, F.lit(0)) + extra).cast("int")).drop(*[f"{c}_{tag}" for c in levels], epochs, cut)


# The parameters of the registered query.
DOMAINS = ("web", "books", "code")
WEIGHTS = [("web", 5), ("books", 3), ("code", 2), ("web/en", 4), ("web/de", 2), ("books/fr", 2), ("code/en", 3), ("web/en/src0", 2)]
SEED, EPOCHS = 7, 4


def with_domain(docs: DataFrame) -> DataFrame:
    """A domain for each source, by the number in its name (documents has none of its own)."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return docs.withColumn("domain", F.when(number == "", F.lit("other")).otherwise(F.element_at(F.array(*map(F.lit, DOMAINS)), (number.cast("long") % 3 + 1).cast("int"))))


def oracle() -> str:
    """The registered query in DuckDB's SQL: budget 6/10 of all words, four epochs at most."""
    weights = ", ".join(f"('{p}', {w})" for p, w in WEIGHTS)

    def level(name: str, here: list[str], up: list[str], parent: str) -> str:
        cols, by = ", ".join(here), ", ".join(up) or "1"
        return f"""
{name}_n AS (SELECT {cols}, n.capacity, greatest(n.weight, 0) AS weight, b.budget AS parent_budget
  FROM (SELECT {cols}, sum(capacity)::HUGEINT AS capacity, any_value(w{len(here)}) AS weight FROM open_leaves GROUP BY {cols}) n JOIN {parent} b {f"USING ({', '.join(up)})" if up else "ON true"}),
{name}_s AS (SELECT *, parent_budget - coalesce(sum(capacity) OVER o, 0) AS remains, sum(weight) OVER (PARTITION BY {by}) - coalesce(sum(weight) OVER o, 0) AS rest
  FROM {name}_n WINDOW o AS (PARTITION BY {by} ORDER BY CASE WHEN weight > 0 THEN capacity / weight ELSE 'infinity'::DOUBLE END, {here[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_l AS (SELECT {name}_n.*, k.remains, k.rest FROM {name}_n LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY capacity / weight, {here[-1]}) AS nth
  FROM {name}_s WHERE weight > 0 AND remains * weight <= capacity * rest) k ON k.nth = 1 {"".join(f" AND k.{c} = {name}_n.{c}" for c in up)}),
{name}_f AS (SELECT *, CASE WHEN weight <= 0 THEN 0 WHEN rest IS NULL OR remains * weight >= capacity * rest THEN capacity ELSE remains * weight // rest END AS share,
  CASE WHEN weight <= 0 OR rest IS NULL OR remains * weight >= capacity * rest THEN 0 ELSE remains * weight % rest END AS fraction FROM {name}_l),
{name} AS (SELECT {cols}, (share + CASE WHEN fraction > 0 AND rest IS NOT NULL AND row_number() OVER (PARTITION BY {by} ORDER BY fraction DESC, {here[-1]}) <= parent_budget - sum(share) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END)::BIGINT AS budget FROM {name}_f)"""

    return f"""
WITH weights AS (SELECT * FROM (VALUES {weights}) w(path, weight)),
docs AS (SELECT doc_id, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
  CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'other' ELSE (['{"','".join(DOMAINS)}'])[CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3 + 1] END AS domain,
  coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {EPOCHS})::BIGINT AS capacity FROM docs GROUP BY ALL),
open_leaves AS (SELECT l.* EXCLUDE (capacity), coalesce(x.weight, 1) AS w1, coalesce(y.weight, 1) AS w2, coalesce(z.weight, 1) AS w3, CASE WHEN least(w1, w2, w3) > 0 THEN capacity ELSE 0 END AS capacity FROM leaves l
  LEFT JOIN weights x ON x.path = domain LEFT JOIN weights y ON y.path = domain || '/' || lang LEFT JOIN weights z ON z.path = domain || '/' || lang || '/' || source),
root AS (SELECT (coalesce(sum(tokens), 0) * 6 // 10)::BIGINT AS budget FROM leaves),
{level("one", ["domain"], [], "root")},
{level("two", ["domain", "lang"], ["domain"], "one")},
{level("three", ["domain", "lang", "source"], ["domain", "lang"], "two")},
leaf AS (SELECT l.domain, l.lang, l.source, l.tokens, b.budget, CASE WHEN l.tokens > 0 THEN b.budget // l.tokens ELSE 0 END AS epochs FROM leaves l JOIN three b USING (domain, lang, source)),
keyed AS (SELECT d.*, leaf.budget, leaf.epochs, leaf.budget - leaf.epochs * leaf.tokens AS remains,
  md5('{SEED}:' || CAST(leaf.epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) AS key FROM docs d JOIN leaf USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN before < remains THEN 1 ELSE 0 END AS INTEGER) AS copies FROM placed"""
