"""Periods and gaps of integer intervals, by run bitmaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Units in one shard: the bits of a long.
SHARD_BITS = 64


def periods_and_gaps(df: DataFrame, entity: Sequence[str], first: str, last: str) -> DataFrame:
    """Merge the intervals of each entity and list what lies between them.

    Returns ``entity columns, kind, line_first, line_last`` (both ends included), one row of kind
    ``period`` for each longest run of covered units and one of kind ``gap`` for each run between
    two periods.

    Each interval is cut into shards of 64 units. A part of a shard is a bitmap (a long), a run of
    whole shards stays a run, whatever its length. ``bit_or`` unions the bitmaps, combined before
    the shuffle, so an entity with a third of all rows reaches the second stage as one long per
    shard it touches. Set runs are read from the bitmaps and joined across shards; the clear runs
    are what lies between.

    Null ``first``: the row covers nothing. Null ``last``: one unit. Reversed ends are exchanged.
    Null entity values form an entity of their own. Repeated rows, ties and extra columns change
    nothing; an empty table gives an empty result.
    """
    keys = [F.col(f"`{c}`").alias(f"e{i}") for i, c in enumerate(entity)]
    names = [f"e{i}" for i in range(len(entity))]
    a, b = F.col(f"`{first}`").cast("long"), F.coalesce(F.col(f"`{last}`"), F.col(f"`{first}`")).cast("long")
    spans = df.where(F.col(f"`{first}`").isNotNull()).select(*keys, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    from_bit = "shiftleft(-1L, CAST(a & 63 AS INT))"
    to_bit = "shiftrightunsigned(-1L, CAST(63 - (b & 63) AS INT))"
    pieces = spans.selectExpr(
        *names,
        f"""inline(CASE WHEN shiftright(a, 6) = shiftright(b, 6)
              THEN array(named_struct('s', shiftright(a, 6), 't', shiftright(b, 6), 'bits', {from_bit} & {to_bit}))
              ELSE filter(array(named_struct('s', shiftright(a, 6), 't', shiftright(a, 6), 'bits', {from_bit}),
                                named_struct('s', shiftright(b, 6), 't', shiftright(b, 6), 'bits', {to_bit}),
                                named_struct('s', shiftright(a, 6) + 1, 't', shiftright(b, 6) - 1, 'bits', -1L)), x -> x.s <= x.t)
              END)""",
    )
    bitmaps = pieces.groupBy(*names, "s", "t").agg(F.bit_or("bits").alias("bits"))
    set_run = bitmaps.selectExpr(
        *names,
        """inline(CASE WHEN bits = -1L THEN array(named_struct('a', s * 64, 'b', t * 64 + 63))
             ELSE zip_with(
               transform(filter(sequence(0, 63), i -> getbit(bits, i) = 1 AND (i = 0 OR getbit(bits, greatest(i - 1, 0)) = 0)), i -> s * 64 + i),
               transform(filter(sequence(0, 63), i -> getbit(bits, i) = 1 AND (i = 63 OR getbit(bits, least(i + 1, 63)) = 0)), i -> s * 64 + i),
               (x, y) -> named_struct('a', x, 'b', y))
             END)""",
    )
    by = Window.partitionBy(*names).orderBy("a", "b")
    island = (
        set_run.withColumn("reach", F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("n", F.sum(F.when(F.col("a") <= F.col("reach") + 1, 0).otherwise(1)).over(by))
        .groupBy(*names, "n")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
    )
    ahead = island.withColumn("next", F.lead("a").over(Window.partitionBy(*names).orderBy("n")))
    out = ahead.selectExpr(
        *names,
        """inline(filter(array(named_struct('kind', 'period', 'line_first', a, 'line_last', b),
                               named_struct('kind', 'gap', 'line_first', b + 1, 'line_last', next - 1)), x -> x.line_last IS NOT NULL))""",
    )
    return out.select(*[F.col(f"e{i}").alias(c) for i, c in enumerate(entity)], "kind", "line_first", "line_last")
