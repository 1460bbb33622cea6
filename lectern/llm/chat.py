"""Chat formatting: logged snapshots that a longer conversation continues are dropped, the rest is rendered.

A chat log often holds a conversation again after every turn. Each turn gets the hash of all turns up to
it (two 64-bit words, each the exclusive-or of hashes over position, role and text, so that prefixes can be
put together from blocks). A conversation whose last hash is an inner hash of another one is a snapshot of
that one and goes (anti-join on the hash); of equal conversations the smallest conv_id stays. What stays is
rendered in the ChatML form, one row a segment of SEGMENT turns, so that a conversation with a third of all rows
is many bounded groups and not one. Turns get their places after a range partitioning by conversation, turn, role
and text: neither a hot conversation nor one turn number (or none) of all its rows comes together in a task.

Cases. Turns are ordered by turn, role, text, nulls first; rows that repeat all of conv_id, turn, role and
text count once; different rows with the same turn both stay, in that order. A null conv_id is one
conversation; a null role is "unknown", a null text is empty; roles are trimmed and in lower case. Marks
of the template inside a text are spelt with a space so that they stay text. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import materialize, table

#: Turns a segment.
SEGMENT = 256
_FIRST = -(1 << 62)


def turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their place in the conversation (from 1), its length and the prefix hashes."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv"),
        F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn"),
        F.lower(F.trim(F.coalesce("role", F.lit("unknown")))).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    conv, order = ["conv", "no_conv"], ["turn", "role", "text"]
    # the range's number is written with the rows, as sampled borders may differ when they are made again
    ranges = rows.repartitionByRange(*conv, *order).withColumn("range", F.spark_partition_id())
    ranges = materialize(ranges, "chat-ranges")
    number = F.row_number().over(Window.partitionBy(*conv, "range").orderBy(*order)).cast("long")
    # places: one row a range, summed over the ranges of a conversation
    whole = Window.partitionBy(*conv)
    sizes = ranges.groupBy(*conv, "range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*conv, "range", F.coalesce(before, F.lit(0)).alias("place_before"), F.sum("size").over(whole).alias("n_turns"))
    rows = ranges.withColumn("n", number).join(sizes, [*conv, "range"]).withColumn("place", F.col("n") + F.col("place_before"))
    rows = rows.withColumn("segment", F.floor((F.col("place") - 1) / SEGMENT))
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), "place", "role", "text"), "h2": F.xxhash64(F.lit(2), "text", "role", "place")})
    upto = Window.partitionBy(*conv, "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"x1": F.bit_xor("h1").over(upto), "x2": F.bit_xor("h2").over(upto)})
    rows = materialize(rows.drop("n", "place_before", "range", "turn"), "chat-turns")
    earlier = whole.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    marks = rows.groupBy(*conv, "segment").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    zero = F.lit(0).cast("long")
    marks = marks.select(*conv, "segment", *[F.coalesce(F.bit_xor(b).over(earlier), zero).alias(b) for b in ("b1", "b2")])
    rows = rows.join(marks, [*conv, "segment"])
    return rows.withColumns({"p1": F.col("x1").bitwiseXOR(F.col("b1")), "p2": F.col("x2").bitwiseXOR(F.col("b2"))}).drop("x1", "x2", "b1", "b2", "h1", "h2")


def maximal(rows: DataFrame) -> DataFrame:
    """conv and no_conv of the conversations that stay, with the number of equal ones."""
    state = ["place", "p1", "p2"]
    longer = rows.groupBy(*state).agg(F.max("n_turns").alias("longest")).where("longest > place")
    # equal conversations are one row before they meet the longer ones
    first = F.min(F.struct("no_conv", "conv")).alias("first")
    ends = materialize(rows.where("place = n_turns").groupBy(*state).agg(first, F.count("*").alias("n_copies")), "chat-ends")
    stay = ends.join(longer, state, "left_anti")
    return stay.select("first.conv", "first.no_conv", "n_copies")


def render(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """One row a segment: conv_id, segment (from 0), n_turns, n_copies, text."""
    safe = F.replace(F.replace("text", F.lit("<|im_start|>"), F.lit("< |im_start|>")), F.lit("<|im_end|>"), F.lit("< |im_end|>"))
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), safe, F.lit("<|im_end|>\n"))
    lines = rows.select("conv", "no_conv", "segment", "place", line.alias("line")).join(materialize(keep, "chat-kept"), ["conv", "no_conv"])
    out = lines.groupBy("conv", "no_conv", "segment", "n_copies").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return out.select(
        F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), "segment", "n_turns", "n_copies",
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"),
    )


def op1_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(turns(table(spark, sf_dir, "conversations")), "chat-prefixes")
    return render(rows, maximal(rows))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, lower(trim(coalesce(role, 'unknown'))) AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
  count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
p AS (SELECT *, md5(string_agg(md5(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY place)) AS prefix FROM r),
longer AS (SELECT place, prefix FROM p GROUP BY 1, 2 HAVING max(n_turns) > place),
ends AS (SELECT conv_id, place, prefix FROM p WHERE place = n_turns),
keep AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM ends ANTI JOIN longer USING (place, prefix) GROUP BY place, prefix)
SELECT conv_id, (place - 1) // {SEGMENT} AS segment, count(*) AS n_turns, any_value(n_copies) AS n_copies,
  string_agg('<|im_start|>' || role || chr(10) || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM r JOIN keep USING (conv_id) GROUP BY conv_id, segment"""
