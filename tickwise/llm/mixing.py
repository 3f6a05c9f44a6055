"""Mixing sources to target weights by hierarchical budgeting (operator 6);
DataFrame functions only.

The sources form a tree: domain - language - source. A token budget flows
down the tree by integer weights. A node whose documents cannot fill its share
even when repeated ``max_epochs`` times is filled up, and what it leaves is
shared among its siblings by their weights; only what all siblings together
cannot take is missed by the parent, whose own siblings take it (a node's
capacity is the sum of its leaves', so this is settled level by level from
the top). Shares are whole tokens: floors, then one more each in name order.

A leaf with a budget of b tokens and t tokens of documents takes b div t whole
epochs and a token prefix of the next one. Each epoch is a permutation of the
leaf by md5(seed, epoch, id). The document that the prefix ends in is taken
with the tokens that are left (``take_tokens``).

The prefix needs running sums over a leaf, which may hold a third of all rows:
the hash splits a leaf into ``BUCKETS`` ranges, whose sums (a row each) tell
the one range in which the prefix ends; ranges before it are taken, those
after it are not, and only that one is put in order.

Cases: null and empty texts have no tokens (they follow the epochs they fall
in); null languages and sources are nodes named ``(none)``; a source without
a number is in domain ``other``; null ids are ordered as empty; repeated rows
are rows of their own; documents of equal hash are ordered by tokens and by a
hash of the text; very long texts are one row; an empty table gives no rows;
other columns are kept by ``mix``, but for those with the names of its results,
which take their place (names starting with two underscores are reserved).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwise.llm.common import read, strip_blanks, without, written

SEED = 17
SHARE = 0.7  # budget as a share of the corpus, where none is given
MAX_EPOCHS = 3
#: Target weights by level; names that aren't listed weigh 1.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 2}}
LEVELS = ("domain", "lang", "source")
BUCKET_DIGITS = 3  # hex digits of the hash: 4,096 ranges a leaf
SMALL_LEAVES = 100_000  # leaves up to which their table is broadcast


def token_count(text: Column) -> Column:
    """Words between blanks (space, TAB..CR)."""
    inner = strip_blanks(text)
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def _nodes(docs: DataFrame, text_column: str) -> DataFrame:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1)
    return (docs.withColumn("__domain", F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), number.try_cast("int") % 4)))
            .withColumn("__lang", F.coalesce("lang", F.lit("(none)"))).withColumn("__source", F.coalesce("source", F.lit("(none)")))
            .withColumn("__tokens", token_count(F.col(text_column))))


def _weight(level: str, weights: dict) -> Column:
    return reduce(lambda c, kv: F.when(F.col(f"__{level}") == kv[0], kv[1]).otherwise(c), weights.get(level, {}).items(), F.lit(1)).cast("long")


def share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Water-filling among siblings: rows (parents, name, cap, w, budget of the
    parent) get ``got``. Exact in integers while cap * sum of weights fits a long."""
    among = Window.partitionBy(*parents)
    order = among.orderBy(F.col("__cap") / F.col("__w"), name).rowsBetween(Window.unboundedPreceding, -1)
    n = (nodes.withColumn("__caps", F.coalesce(F.sum("__cap").over(order), F.lit(0)))
         .withColumn("__rest", F.sum("__w").over(among) - F.coalesce(F.sum("__w").over(order), F.lit(0)))
         .withColumn("__full", F.col("__cap") * F.col("__rest") <= F.col("__w") * (F.col("__budget") - F.col("__caps"))))
    n = (n.withColumn("__left", F.col("__budget") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(among), F.lit(0)))
         .withColumn("__open", F.sum(F.when(~F.col("__full"), F.col("__w"))).over(among))
         .withColumn("__floor", F.when(F.col("__full"), F.col("__cap")).otherwise(F.expr("(__w * __left) div __open"))))
    over = F.col("__left") - F.sum(F.when(~F.col("__full"), F.col("__floor"))).over(among)
    place = F.sum(F.when(~F.col("__full"), 1)).over(among.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    return (n.withColumn("__over", over).withColumn("__place", place)
            .withColumn("__got", F.col("__floor") + F.when(~F.col("__full") & (F.col("__place") <= F.col("__over")), 1).otherwise(0))
            .drop("__caps", "__rest", "__full", "__left", "__open", "__floor", "__over", "__place"))


def budgets(leaves: DataFrame, weights: dict, budget: int | None, share: float, max_epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``__got`` tokens each."""
    keys = [f"__{level}" for level in LEVELS]
    leaves = leaves.withColumn("__cap", F.col("__sum") * max_epochs)
    whole = leaves.agg(F.least(F.sum("__cap"), F.lit(budget) if budget is not None else F.floor(F.sum("__sum") * F.lit(share))).cast("long").alias("__budget"))
    above = whole.withColumn("__root", F.lit(0))
    for depth, level in enumerate(LEVELS):
        parents = ["__root", *keys[:depth]]
        nodes = (leaves.withColumn("__root", F.lit(0)).groupBy("__root", *keys[:depth + 1]).agg(F.sum("__cap").alias("__cap"))
                 .withColumn("__w", _weight(level, weights)).join(above, parents))
        above = share_out(nodes, parents, keys[depth]).select("__root", *keys[:depth + 1], F.col("__got").alias("__budget"))
    return leaves.join(above.withColumnRenamed("__budget", "__got").drop("__root"), keys)


def _place(seed: int, epoch: Column, id_column: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch, F.coalesce(F.col(id_column).cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: dict = WEIGHTS, budget: int | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` once per epoch that they are taken in, with ``domain``,
    ``n_tokens``, ``epoch`` (from 0) and ``take_tokens``."""
    docs = without(docs, ("domain", "n_tokens", "epoch", "take_tokens"), id_column, text_column, "lang", "source")
    keys = [f"__{level}" for level in LEVELS]
    rows = _nodes(docs, text_column)
    leaves = written(rows.groupBy(*keys).agg(F.sum("__tokens").alias("__sum"), F.count("*").alias("__rows")), "mix-leaves")
    plan = budgets(leaves, weights, budget, share, max_epochs)
    plan = plan.withColumn("__epochs", F.when(F.col("__sum") > 0, F.expr("__got div __sum")).otherwise(F.lit(0))).withColumn(
        "__part", F.when(F.col("__sum") > 0, F.expr("__got % __sum")).otherwise(F.lit(0))).select(*keys, "__epochs", "__part")
    plan = written(plan, "mix-plan")
    few = plan.count() <= SMALL_LEAVES

    def with_plan(side: DataFrame) -> DataFrame:
        placed = rows.join(F.broadcast(side) if few else side, keys)
        return placed.withColumn("__place", _place(seed, F.col("__epochs"), id_column)).withColumn("__range", F.substring("__place", 1, BUCKET_DIGITS))

    sums = with_plan(plan).where(F.col("__part") > 0).groupBy(*keys, "__range").agg(F.sum("__tokens").alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).join(plan, keys)
            .where((F.col("__ahead") < F.col("__part")) & (F.col("__part") <= F.col("__ahead") + F.col("__sum")))
            .select(*keys, F.col("__range").alias("__end"), "__ahead"))
    placed = with_plan(written(plan.join(ends, keys, "left"), "mix-ends"))

    before = F.when(F.col("__range") < F.col("__end"), F.array("__epochs")).otherwise(F.array().cast("array<bigint>"))
    full = F.when(F.col("__epochs") > 0, F.sequence(F.lit(0).cast("long"), F.col("__epochs") - 1)).otherwise(F.array().cast("array<bigint>"))
    whole = placed.withColumn("__epoch", F.explode(F.concat(full, before))).withColumn("__take", F.col("__tokens"))
    within = (Window.partitionBy(*keys).orderBy("__place", "__tokens", F.xxhash64(text_column)).rowsBetween(Window.unboundedPreceding, -1))
    edge = (placed.where(F.col("__range") == F.col("__end"))
            .withColumn("__left", F.col("__part") - F.col("__ahead") - F.coalesce(F.sum("__tokens").over(within), F.lit(0)))
            .where(F.col("__left") > 0).withColumn("__epoch", F.col("__epochs")).withColumn("__take", F.least("__tokens", "__left")))
    out = [*docs.columns, F.col("__domain").alias("domain"), F.col("__tokens").alias("n_tokens"), F.col("__epoch").alias("epoch"), F.col("__take").alias("take_tokens")]
    return whole.select(*out).unionByName(edge.select(*out))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "take_tokens")


def _op6_sql() -> str:
    def weight(level: str) -> str:
        return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items()) + " ELSE 1 END"

    levels, text = [], ""
    for depth, level in enumerate(LEVELS):
        up = levels[:]
        levels.append(level)
        cols, part = ", ".join(levels), f"PARTITION BY {', '.join(up)}" if up else ""
        join = f"JOIN got{depth - 1} USING ({', '.join(up)})" if up else "CROSS JOIN (SELECT budget AS got FROM whole)"
        text += f"""
n{depth} AS (SELECT t.*, got AS budget, {weight(level)} AS w FROM (SELECT {cols}, sum(cap) AS cap FROM leaves GROUP BY ALL) t {join}),
a{depth} AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, sum(w) OVER ({part}) - coalesce(sum(w) OVER o, 0) AS rest FROM n{depth}
  WINDOW o AS ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b{depth} AS (SELECT *, cap * rest <= w * (budget - caps) AS is_full FROM a{depth}),
c{depth} AS (SELECT *, budget - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0) AS remaining, sum(w) FILTER (NOT is_full) OVER ({part}) AS open FROM b{depth}),
d{depth} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (w * remaining) // open END AS low FROM c{depth}),
e{depth} AS (SELECT *, remaining - sum(low) FILTER (NOT is_full) OVER ({part}) AS over_, count(*) FILTER (NOT is_full) OVER ({part} ORDER BY {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM d{depth}),
got{depth} AS (SELECT {cols}, (low + CASE WHEN NOT is_full AND place <= over_ THEN 1 ELSE 0 END)::HUGEINT AS got FROM e{depth}),"""
    return f"""
WITH base AS (
  SELECT doc_id, text, lang AS own_lang, source AS own_source, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]{{1,9}}$')
              THEN 'domain' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4) ELSE 'other' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {MAX_EPOCHS} AS cap FROM base GROUP BY ALL),
whole AS (SELECT least(sum(cap), floor(sum(tokens) * {SHARE}::DOUBLE)::HUGEINT) AS budget FROM leaves),{text}
plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN got // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN got % tokens ELSE 0 END AS part
         FROM leaves l JOIN got2 USING (domain, lang, source)),
placed AS (SELECT b.*, p.epochs, p.part, md5('{SEED}|' || p.epochs || '|' || coalesce(doc_id::VARCHAR, '')) AS place
           FROM base b JOIN plan p USING (domain, lang, source)),
summed AS (SELECT *, part - coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM placed)
SELECT doc_id, domain, own_lang AS lang, own_source AS source, tokens::BIGINT AS n_tokens, epochs::BIGINT AS epoch, least(tokens, remaining)::BIGINT AS take_tokens
FROM summed WHERE remaining > 0
UNION ALL
SELECT doc_id, domain, own_lang, own_source, tokens::BIGINT, unnest(range(epochs::BIGINT))::BIGINT, tokens::BIGINT FROM placed
"""


OP6_SQL = _op6_sql()
