"""Mixing sources to target weights: budgets down a domain-language-source tree, prefixes of seeded epochs.

Budgets. A leaf can give its tokens max_epochs times. Going down the tree, a node's budget is split among
its children by weight; a child that cannot take its share gives what is left to its siblings in
proportion to their weights (a water level, found with running sums over the children ordered by capacity
per weight). Only what all siblings together cannot take is missing at the parent, and there the parent's
own siblings take it: shortages move to siblings before ancestors.

Selection. A leaf with budget b and t tokens takes b div t whole epochs and, of the next epoch, the longest
prefix that fits, in the order of a seeded hash. A prefix is known by its last key, so that a document is
judged by its own row and its leaf's; texts are never shuffled. Keys are split into 256 buckets a leaf, so
that a leaf with a third of all rows is summed by many tasks, and only the bucket that holds the cut is ordered.

Cases. A null text has no tokens and is taken where the prefix reaches it; null languages and sources are
leaves of their own named "(none)"; rows that are equal in doc_id and text share a key and are taken
together or not at all; a leaf without any
tokens has the budget 0, into which all its rows fit, so they are taken once. An empty table gives no rows. Extra columns
stay, except n_copies and those that begin with "mix_", which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import materialize, table

SEED = "mix-1"
#: Production weights; what is not listed has weight 1.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANGUAGE_WEIGHTS = {"en": 6, "fr": 2, "de": 2}
LEAF = ["mix_domain", "mix_language", "mix_source"]
WORD = "[^ \\n\\r\\t]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def domain_of(source: Column) -> Column:
    """The domain stands in the last digits of a source's name, modulo 4."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("domain"), F.coalesce(digits.try_cast("long") % 4, F.lit(0).cast("long")).cast("string"))


def weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1.0)
    for key, value in weights.items():
        out = F.when(name == key, float(value)).otherwise(out)
    return out


def tagged(docs: DataFrame) -> DataFrame:
    """docs with the leaf, the token count and the digest of the text that keys use."""
    return docs.withColumns(
        {
            "mix_domain": domain_of(F.col("source")),
            "mix_language": F.coalesce("lang", F.lit("(none)")),
            "mix_source": F.coalesce("source", F.lit("(none)")),
            "mix_tokens": n_tokens(F.col("text")),
            "mix_digest": F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
        }
    )


def order_key(epoch: Column, seed: str) -> Column:
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), doc, F.col("mix_digest")).cast("binary"))


def fill(nodes: DataFrame, parent: list[str], child: str, budget: str, weights: dict[str, int], out: str) -> DataFrame:
    """nodes has the columns of parent, child, cap and the parent's budget; out becomes the child's budget."""
    nodes = nodes.withColumn("w", weight(F.col(child), weights))
    group = Window.partitionBy(*parent)
    before = group.orderBy(F.col("cap") / F.col("w"), child).rowsBetween(Window.unboundedPreceding, -1)
    cap, w = F.col("cap").cast("double"), F.col("w")
    zero = F.lit(0.0)
    nodes = nodes.withColumns({"cap_before": F.coalesce(F.sum(cap).over(before), zero), "w_before": F.coalesce(F.sum(w).over(before), zero), "w_all": F.sum(w).over(group)})
    short = cap * (F.col("w_all") - F.col("w_before")) <= (F.col(budget) - F.col("cap_before")) * w
    nodes = nodes.withColumn("short", short)
    nodes = nodes.withColumns(
        {
            "cap_short": F.sum(F.when(F.col("short"), cap).otherwise(zero)).over(group),
            "w_short": F.sum(F.when(F.col("short"), w).otherwise(zero)).over(group),
        }
    )
    share = (F.col(budget) - F.col("cap_short")) * w / (F.col("w_all") - F.col("w_short"))
    value = F.when(F.col("short"), F.col("cap")).otherwise(F.floor(share).cast("long"))
    return nodes.withColumn(out, value).drop("w", "cap_before", "w_before", "w_all", "short", "cap_short", "w_short")


def budgets(leaves: DataFrame, fraction: float, max_epochs: int) -> DataFrame:
    """leaves: LEAF and tokens. Adds budget, whole (epochs) and rest (tokens of the next one)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    domains = leaves.groupBy("mix_domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("domain_tokens")).withColumn("root", F.lit(0))
    all_tokens = F.sum("domain_tokens").over(Window.partitionBy("root"))  # one row a domain
    domains = domains.withColumn("root_budget", F.floor(all_tokens * fraction).cast("long"))
    domains = fill(domains, ["root"], "mix_domain", "root_budget", DOMAIN_WEIGHTS, "domain_budget")
    languages = leaves.groupBy("mix_domain", "mix_language").agg(F.sum("cap").alias("cap"))
    languages = languages.join(domains.select("mix_domain", "domain_budget"), "mix_domain")
    languages = fill(languages, ["mix_domain"], "mix_language", "domain_budget", LANGUAGE_WEIGHTS, "language_budget")
    out = leaves.join(languages.select("mix_domain", "mix_language", "language_budget"), ["mix_domain", "mix_language"])
    out = fill(out, ["mix_domain", "mix_language"], "mix_source", "language_budget", {}, "budget")
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")
    return out.select(*LEAF, "tokens", "budget", whole.alias("whole")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))


def plan(rows: DataFrame, fraction: float, max_epochs: int, seed: str = SEED) -> DataFrame:
    """One row a leaf: budget, whole epochs and the last key of the next epoch's prefix (null: nothing fits).

    rows holds doc_id, LEAF, mix_tokens and mix_digest; it is read three times and should be a table.
    """
    leaves = materialize(budgets(rows.groupBy(*LEAF).agg(F.sum("mix_tokens").alias("tokens")), fraction, max_epochs), "mix-leaves")
    keyed = rows.join(leaves.select(*LEAF, "whole", "rest"), LEAF).withColumn("key", order_key(F.col("whole"), seed))
    keyed = keyed.select(*LEAF, "rest", "key", F.substring("key", 1, 2).alias("bucket"), "mix_tokens")
    buckets = keyed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("mix_tokens").alias("t"), F.max("key").alias("last"))
    earlier = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = materialize(buckets.withColumn("before", F.coalesce(F.sum("t").over(earlier), F.lit(0))), "mix-buckets")
    fits = F.col("before") + F.col("t") <= F.col("rest")
    whole = buckets.where(fits).select(*LEAF, F.col("last").alias("key"))
    cut = buckets.where(~fits & (F.col("before") <= F.col("rest"))).select(*LEAF, "bucket", "before")
    inside = Window.partitionBy(*LEAF, "bucket").orderBy("key")  # equal keys count together
    edge = keyed.join(cut, [*LEAF, "bucket"]).withColumn("upto", F.col("before") + F.sum("mix_tokens").over(inside))
    edge = edge.where("upto <= rest").select(*LEAF, "key")
    last = whole.unionByName(edge).groupBy(*LEAF).agg(F.max("key").alias("last_key"))
    return leaves.join(last, LEAF, "left")


def mix(docs: DataFrame, fraction: float = 0.6, max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """docs with the mix columns and n_copies, the number of epochs that take the row (1 or more)."""
    rows = tagged(docs)
    small = materialize(rows.select("doc_id", *LEAF, "mix_tokens", "mix_digest"), "mix-rows")
    leaf = materialize(plan(small, fraction, max_epochs, seed), "mix-plan")
    own = {"budget": "mix_budget", "whole": "mix_whole", "last_key": "mix_last"}
    out = rows.drop(*own.values()).join(leaf.select(*LEAF, *(F.col(c).alias(n) for c, n in own.items())), LEAF)
    more = F.coalesce(order_key(F.col("mix_whole"), seed) <= F.col("mix_last"), F.lit(False)).cast("long")
    return out.withColumn("n_copies", F.col("mix_whole") + more).where("n_copies > 0")


def op6_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_language").alias("language"), F.col("mix_source").alias("origin"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_budget").alias("leaf_budget"), "n_copies")


def _case(column: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}.0::DOUBLE" for k, v in weights.items()) + " ELSE 1.0::DOUBLE END" if weights else "1.0::DOUBLE"


def _fill_sql(name: str, source: str, parent: str, child: str, budget: str, weights: dict[str, int], out: str) -> str:
    return f"""
{name}_a AS (SELECT *, {_case(child, weights)} AS w FROM {source}),
{name}_b AS (SELECT *, coalesce(sum(cap::DOUBLE) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before, sum(w) OVER (PARTITION BY {parent}) AS w_all
  FROM {name}_a WINDOW b AS (PARTITION BY {parent} ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_c AS (SELECT *, cap * (w_all - w_before) <= ({budget} - cap_before) * w AS short FROM {name}_b),
{name}_d AS (SELECT *, sum(CASE WHEN short THEN cap::DOUBLE ELSE 0 END) OVER (PARTITION BY {parent}) AS cap_short, sum(CASE WHEN short THEN w ELSE 0 END) OVER (PARTITION BY {parent}) AS w_short FROM {name}_c),
{name} AS (SELECT * EXCLUDE (w, cap_before, w_before, w_all, short, cap_short, w_short),
  CASE WHEN short THEN cap ELSE floor(({budget} - cap_short) * w / (w_all - w_short))::BIGINT END AS {out} FROM {name}_d)"""


def mix_sql(source: str, fraction: float, max_epochs: int, seed: str = SEED, prefix: str = "") -> str:
    """WITH parts that end in the table {prefix}mixed: source's columns, the mix columns and n_copies."""
    p = prefix
    return f"""
{p}tag AS (SELECT *, 'domain' || coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4, 0) AS mix_domain,
  coalesce(lang, '(none)') AS mix_language, coalesce(source, '(none)') AS mix_source,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS mix_tokens, md5(coalesce(text, '')) AS mix_digest FROM {source}),
{p}leaf AS (SELECT mix_domain, mix_language, mix_source, sum(mix_tokens)::BIGINT AS tokens, (sum(mix_tokens) * {max_epochs})::BIGINT AS cap FROM {p}tag GROUP BY ALL),
{p}root AS (SELECT mix_domain, 0 AS root, sum(cap)::BIGINT AS cap, floor((SELECT sum(tokens) FROM {p}leaf) * {fraction}::DOUBLE)::BIGINT AS root_budget FROM {p}leaf GROUP BY mix_domain),
{_fill_sql(p + "dom", p + "root", "root", "mix_domain", "root_budget", DOMAIN_WEIGHTS, "domain_budget")},
{p}langs AS (SELECT l.mix_domain, mix_language, sum(l.cap)::BIGINT AS cap, any_value(domain_budget) AS domain_budget FROM {p}leaf l JOIN {p}dom d USING (mix_domain) GROUP BY l.mix_domain, mix_language),
{_fill_sql(p + "lan", p + "langs", "mix_domain", "mix_language", "domain_budget", LANGUAGE_WEIGHTS, "language_budget")},
{p}srcs AS (SELECT l.*, language_budget FROM {p}leaf l JOIN {p}lan USING (mix_domain, mix_language)),
{_fill_sql(p + "src", p + "srcs", "mix_domain, mix_language", "mix_source", "language_budget", {}, "budget")},
{p}plan AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM {p}src),
{p}keyed AS (SELECT t.*, p.budget, p.whole, p.budget - p.whole * p.tokens AS rest,
  md5(concat_ws('|', '{seed}', p.whole::VARCHAR, coalesce(t.doc_id::VARCHAR, 'null'), mix_digest)) AS key FROM {p}tag t JOIN {p}plan p USING (mix_domain, mix_language, mix_source)),
{p}cum AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY mix_domain, mix_language, mix_source ORDER BY key) AS upto FROM {p}keyed),
{p}mixed AS (SELECT *, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM {p}cum WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0)"""


ORACLE = f"""WITH {mix_sql("documents", 0.6, 3)}
SELECT doc_id, mix_domain AS domain, mix_language AS language, mix_source AS origin, mix_tokens AS n_tokens, budget AS leaf_budget, n_copies FROM mixed"""
