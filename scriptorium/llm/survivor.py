"""The best representative of each group of copies, with currency reasoning where time is missing.

A group is the rows of one place: one work (whatever its edition and key), one citation path, one
leaf. Rows whose text is much shorter than the longest of the group drop out, then the most trusted
source wins, then the latest load. Where load times are missing, the order in which the timestamped
rows of all groups went from one state to the next (source, way of writing the place) is learned as
a precedence between states. It is closed over longer chains and freed of cycles, so that it is a
partial order; in the part of it that a group sees, the row that comes topologically last is the
most current. What is known of the work (author, title, unit) is built field by field.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import ref_parts
from ..functions.text import base_letter_table, strip_blanks
from ..session import map_batches, materialise

#: Shortest text that stays in the choice, as a share (numerator, denominator) of the group's longest.
LEAST_SHARE = (4, 5)
#: Rank of a source without trust.
NO_TRUST = -(2**31)


def work_identity(key: Column, code: Column) -> Column:
    """One key for all editions of a work.

    A first part that is the ``code`` of the edition's source, the ending of a file name, case,
    marks, every sign and the choice between u and v, i and j carry nothing. Null stays null; a
    null code is no part of any key.
    """
    src, dst = base_letter_table()
    k = F.regexp_replace(F.lower(F.translate(strip_blanks(key), src, dst)), r"\.(txt|xml|html?)$", "")
    first = F.regexp_extract(k, r"^([\p{L}\p{N}]+)[^\p{L}\p{N}]", 1)
    plain_code = F.lower(F.translate(code, src, dst))
    rest = F.when(first == plain_code, F.substr(k, F.length(first) + 1)).otherwise(k)
    return F.regexp_replace(rest, r"[^\p{L}\p{N}]+", "")


def editions(works: DataFrame, sources: DataFrame) -> DataFrame:
    """``(work_id, identity, source, trust, author, title, unit)``: one row for each work id; of
    several the least (key, source) holds. The source table is the small side, by the planner's sizes."""
    s = sources.groupBy("source").agg(F.max("trust").alias("trust"), F.min("code").alias("code"))
    w = works.groupBy("id").agg(F.min(F.struct("key", "source", "author", "title", "unit")).alias("w")).select(F.col("id").alias("work_id"), "w.*")
    return w.join(s, "source", "left").select("work_id", work_identity(F.col("key"), F.col("code")).alias("identity"), "source", "trust", "author", "title", "unit")


def work_records(works: DataFrame, sources: DataFrame) -> DataFrame:
    """``(identity, author, title, unit)``: of each field the filled value of the most trusted
    edition; ties go to the smallest work id. Blank counts as missing; null where no edition has one."""
    e = editions(works, sources).where(F.col("identity").isNotNull())
    rank = [F.coalesce("trust", F.lit(NO_TRUST)).alias("t"), (-F.col("work_id")).alias("w")]
    filled = lambda c: F.when(strip_blanks(F.col(c)) != "", F.struct(*rank, strip_blanks(F.col(c)).alias("v")))
    return e.groupBy("identity").agg(*[F.max(filled(c))["v"].alias(c) for c in ("author", "title", "unit")])


def ref_style(ref: Column, leaf: Column) -> Column:
    """How a place is written: a small set of styles, used as states of the currency reasoning."""
    return F.concat_ws(
        "+",
        F.when(ref.rlike("(?i)[ivxlcdm]"), "roman"),
        F.when(ref.rlike(r"(^|[^0-9])0[0-9]"), "padded"),
        F.when(ref.rlike(r"[,:;]"), "signs"),
        F.when(ref.rlike(r"[\s\p{Z}]|\.$"), "loose"),
        F.when(leaf.isNull(), "whole"),
    )


def places(loc: DataFrame, works: DataFrame, sources: DataFrame) -> DataFrame:
    """Each loc row with the ``place`` it stands for (``identity``, ``path``), ``trust``, ``source``,
    ``style``, ``length`` (characters without outer blanks, null as empty) and its ``loaded_at``.

    A leaf may stand at the end of ``ref`` instead of, or as well as, in ``leaf``: the usual depth of
    the work's references, counted over all its rows, tells which. Rows without work or path have a
    null ``path`` and belong to no place.
    """
    w = editions(works, sources).select("work_id", "identity", "source", "trust")
    needed = loc.select("loc_id", "work_id", "ref", "leaf", "text", "loaded_at")
    rows = needed.join(w, "work_id").select(
        "loc_id", "identity", "source", "trust", "loaded_at", ref_parts(F.col("ref")).alias("parts"), F.col("leaf").cast("string").alias("leaf"), ref_style(F.col("ref"), F.col("leaf")).alias("style"), F.coalesce(F.length(strip_blanks(F.col("text"))), F.lit(0)).alias("length")
    )
    depth = (
        rows.where(F.col("leaf").isNotNull() & F.col("parts").isNotNull())
        .groupBy("identity", F.size("parts").alias("depth"))
        .count()
        .groupBy("identity")
        .agg(F.max(F.struct("count", (-F.col("depth")).alias("d"))).alias("m"))
        .select("identity", (-F.col("m.d")).alias("depth"))
    )
    n = F.size("parts")
    path = (
        F.when(F.col("leaf").isNotNull() & (n == F.col("depth") + 1) & (F.element_at("parts", -1) == F.col("leaf")), F.col("parts"))
        .when(F.col("leaf").isNotNull(), F.concat("parts", F.array("leaf")))
        .when(n > F.col("depth"), F.col("parts"))
    )
    return rows.join(depth, "identity", "left").withColumn("path", F.array_join(F.when(n > 0, path), ".")).drop("parts", "depth")


def _partial_order(batches: Iterator) -> Iterator:
    """The moves between states, all in one batch or several, as a closed partial order."""
    import numpy as np
    import pyarrow as pa

    moves = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    names = sorted({x for a, b, _ in moves for x in (a, b)})
    at = {x: k for k, x in enumerate(names)}
    seen = np.zeros((len(names), len(names)), np.int64)
    for a, b, n in moves:
        seen[at[a], at[b]] = n
    reach = np.where(seen > seen.T, seen, 0)  # a move seen as often backwards says nothing
    for k in range(len(names)):
        reach = np.maximum(reach, np.minimum(reach[:, k : k + 1], reach[k : k + 1, :]))
    before, after = np.nonzero(reach > reach.T)
    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in x], pa.string()) for x in (before, after)], names=["earlier", "later"])


def learned_precedence(states: DataFrame) -> DataFrame:
    """``(earlier, later)`` pairs of states, learned from the timestamped rows of all groups.

    ``states`` has one row per group and state with the earliest load time. What is counted are the
    moves from a state to the next of its group. A chain of moves is as strong as its rarest move,
    and a precedes b if the strongest chain from a to b is stronger than the one back: that relation
    has no cycles and holds over chains (the beat-path order of Schulze, 2011). The states are as
    many as sources times ways of writing, so the table of moves has a bound and one task closes it.
    """
    timed = states.where(F.col("first").isNotNull())
    nxt = timed.withColumn("prev", F.lag("state").over(Window.partitionBy("identity", "path").orderBy("first", "state")))
    moves = nxt.where(F.col("prev").isNotNull()).groupBy("prev", "state").count()
    return map_batches(moves.coalesce(1), _partial_order, "earlier string, later string")


def survivors(loc: DataFrame, works: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each place with two or more rows: ``loc_id`` of the survivor, ``copies``,
    ``identity``, ``path``.

    Combined before the shuffle: what reaches a group is one row for each different (length, trust,
    state), so a place with a third of all rows is no larger than another. Null or blank texts have
    length 0 and survive only among their like. A source without trust comes after all others.
    Without any load time in the best class, the topologically last state wins: the one that most
    states of its group precede, which in a partial order is never before another. A row without
    time beats one with time only if its state is learned to come later. Ties go to the smallest loc_id.
    Rows of unknown work, without ref or without leaf belong to no group. Empty tables give nothing.
    """
    rows = places(loc, works, sources).where(F.col("path").isNotNull() & F.col("identity").isNotNull())
    state = F.concat_ws("|", F.coalesce("source", F.lit("")), "style")
    brief = (
        rows.withColumn("state", state)
        .groupBy("identity", "path", "length", "trust", "state")
        .agg(
            F.max(F.struct("loaded_at", (-F.col("loc_id")).alias("minus"))).alias("best"),
            F.max(F.when(F.col("loaded_at").isNull(), -F.col("loc_id"))).alias("untimed"),
            F.min("loaded_at").alias("first"),
            F.count("*").alias("n"),
        )
    )
    brief = materialise(brief)
    states = brief.groupBy("identity", "path", "state").agg(F.min("first").alias("first"))
    before = learned_precedence(states)
    by = Window.partitionBy("identity", "path")
    fit = (
        brief.withColumn("copies", F.sum("n").over(by))
        .withColumn("longest", F.max("length").over(by))
        .where((F.col("copies") >= 2) & (F.col("length") * LEAST_SHARE[1] >= F.col("longest") * LEAST_SHARE[0]))
        .withColumn("top", F.max(F.coalesce("trust", F.lit(NO_TRUST))).over(by))
        .where(F.coalesce("trust", F.lit(NO_TRUST)) == F.col("top"))
    )
    # one candidate per state: its latest timed row, and its untimed row
    candidates = fit.select(
        "identity", "path", "copies", "state",
        F.explode(F.filter(F.array(
            F.struct(F.col("best.loaded_at").alias("at"), F.col("best.minus").alias("minus")),
            F.struct(F.lit(None).cast("timestamp").alias("at"), F.col("untimed").alias("minus"))),
            lambda x: x["minus"].isNotNull() & (x["at"].isNotNull() | x["minus"].eqNullSafe(F.col("untimed"))))).alias("x"),
    ).groupBy("identity", "path", "copies", "state", F.col("x.at").isNull().alias("untimed")).agg(F.max("x").alias("x"))
    timed = candidates.where(~F.col("untimed")).groupBy("identity", "path", "copies").agg(F.max(F.struct("x.at", "x.minus", "state")).alias("last"))
    # depth of an untimed state: how many states of its group are learned to precede it
    group_states = candidates.select("identity", "path", F.col("state").alias("earlier")).distinct()
    untimed = candidates.where(F.col("untimed")).select("identity", "path", "copies", "state", F.col("x.minus").alias("minus"))
    ranked = (
        untimed.join(group_states, ["identity", "path"])
        .join(before.withColumnRenamed("later", "state").withColumn("hit", F.lit(1)), ["earlier", "state"], "left")
        .groupBy("identity", "path", "copies", "state", "minus")
        .agg(F.count("hit").alias("rank"), F.collect_set(F.when(F.col("hit") == 1, F.col("earlier"))).alias("after"))
        .groupBy("identity", "path", "copies")
        .agg(F.max(F.struct("rank", "minus", "after")).alias("guess"))
    )
    both = timed.join(ranked, ["identity", "path", "copies"], "full")
    chosen = F.when(F.col("last").isNull() | F.array_contains("guess.after", F.col("last.state")), F.col("guess.minus")).otherwise(F.col("last.minus"))
    return both.select((-chosen).alias("loc_id"), "copies", "identity", "path")
