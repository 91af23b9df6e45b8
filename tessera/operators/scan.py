"""State machines over ordered rows as a segmented scan.

A machine has the states -1, 0 and 1, so what a row does is a function on three states: a code of three digits in base 3. Functions
compose, and composing is associative: slices of a series are composed side by side, their totals are composed the same
way, level by level, and each slice goes on from what came before it. Series are cut by ranges of their order,
so a single long one is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.staging import staged

#: Slices have 2 ** STEPS rows at most: the rows that STEPS doublings reach.
STEPS = 10
SLICE = 1 << STEPS
#: The code of the function that leaves each state as it is: the digits 0, 1 and 2.
SAME = 5


def code(short: Column | int, flat: Column | int, long: Column | int) -> Column:
    """The function that turns -1, 0 and 1 into these."""
    digits = [x if isinstance(x, Column) else F.lit(x) for x in (short, flat, long)]
    return ((digits[0] + 1) * 9 + (digits[1] + 1) * 3 + digits[2] + 1).cast("int")


def composed(first: str, later: str) -> Column:
    """Of two columns of codes, that of the first function and then the later one: the later one's digits in the order of the first one's."""
    digit = lambda at: f"({later} div CASE {at} WHEN 0 THEN 9 WHEN 1 THEN 3 ELSE 1 END % 3)"
    return F.expr(f"cast({digit(f'({first} div 9)')} * 9 + {digit(f'({first} div 3 % 3)')} * 3 + {digit(f'({first} % 3)')} AS int)")


def state_of(h: str) -> Column:
    """Where a function takes 0."""
    return F.expr(f"cast({h} div 3 % 3 - 1 AS int)")


def inclusive(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """rows with h composed from the first row of the group to each, by doubling the reach; groups are slices."""
    line = Window.partitionBy(*group).orderBy(order)
    for k in range(STEPS):
        rows = rows.withColumn("_a", F.lag("h", 1 << k).over(line)).withColumn("h", F.when(F.col("_a").isNull(), F.col("h")).otherwise(composed("_a", "h")))
    return rows.drop("_a")


def exclusive(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows(key, j, h), j from 0 and under most, to key, j and before: the composition of all rows of the key before j."""
    blocks = rows.withColumn("block", F.expr(f"j div {SLICE}"))
    inside = inclusive(blocks, [key, "block"], "j")
    last = F.lag("h").over(Window.partitionBy(key, "block").orderBy("j"))
    shifted = inside.select(key, "j", "block", F.coalesce(last, F.lit(SAME)).alias("before"))
    if most <= SLICE:
        return shifted.drop("block")
    totals = inside.groupBy(key, "block").agg(F.max_by("h", "j").alias("h")).withColumnRenamed("block", "j")
    carry = exclusive(totals, key, -(-most // SLICE)).select(key, F.col("j").alias("block"), F.col("before").alias("carry"))
    return shifted.join(carry, [key, "block"]).select(key, "j", composed("carry", "before").alias("before"))


def run(rows: DataFrame, step: Column, key: str = "ticker", order: str = "date") -> DataFrame:
    """rows with state, the state after each row, from 0 before the first row of its key; step is each row's code().

    Also place, the row's place in its series, and entered, the place where its state was entered; null in state 0.
    """
    slice_ = [key, "_part", "_slice"]
    ranged = staged(rows.withColumn("h", step).repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))
    placed = ranged.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)) - 1).withColumn("_slice", F.expr(f"_i div {SLICE}"))
    done = staged(inclusive(placed, slice_, "_i"))
    totals = done.groupBy(*slice_).agg(F.max_by("h", "_i").alias("h"), F.count("*").alias("_n"))
    line = Window.partitionBy(key).orderBy("_part", "_slice")
    ordered = staged(totals.withColumn("j", F.row_number().over(line) - 1).withColumn("_from", F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    most = (ordered.agg(F.max("j")).first()[0] or 0) + 1
    before = ordered.join(exclusive(ordered.select(key, "j", "h"), key, most), [key, "j"]).select(*slice_, "j", "_from", "before")
    own = Window.partitionBy(*slice_).orderBy("_i")
    joined = done.join(before, slice_).withColumn("h", composed("before", "h")).withColumn("state", state_of("h"))
    was = F.coalesce(F.lag("state").over(own), state_of("before"))
    row_in_slice = F.col("_i") % SLICE
    marked = joined.withColumn("place", F.col("_from") + row_in_slice).withColumn("_entry", F.when((F.col("state") != 0) & (F.col("state") != was), F.col("place")))
    marked = staged(marked.withColumn("_last", F.max("_entry").over(own)))
    ends = marked.groupBy(key, "j").agg(F.max("_last").alias("_end"))
    earlier = ends.select(key, "j", F.max("_end").over(Window.partitionBy(key).orderBy("j").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    found = marked.join(earlier, [key, "j"]).withColumn("entered", F.when(F.col("state") != 0, F.coalesce("_last", "_earlier")))
    return found.select(*rows.columns, "state", "place", "entered")
