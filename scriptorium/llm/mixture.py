"""Mixing sources to target weights by Poisson replication.

Each document gets, from its id and a seed, a uniform number u. Inverting the Poisson distribution
at u gives how often the document is taken at a mean repetition rate r, at most as often as its
source allows. For a fixed u that count only grows with r, so the k-th copy has a rate at which it
enters; each source's rate is set where the copies that have entered reach its share in tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, spread
from .tokenise import TOKENIZERS, VOCABULARY, token_count

#: Steps in which a source's rate is searched, a fixed number, so the histograms have a bound.
RATE_STEPS = 1 << 16
#: Halvings in which the rate is found at which a copy enters: enough for the last bit of a step.
HALVINGS = 40
SEED = 17
#: Sources up to which the plan of the mixture, one row each, is sent to all tasks; beyond, it is joined
#: by a shuffle.
MOST_SENT = 10_000


def _uniform(document: Column, seed: int) -> Column:
    """A number in (0, 1) from the document id; the same in every run."""
    return (F.pmod(F.xxhash64(F.lit(seed), document), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _entry_rate(u: Column, k: Column) -> Column:
    """The Poisson mean at which the inverse distribution at ``u`` first gives ``k`` or more.

    The root of P(X < k; rate) = u. For any u of 52 bits it lies below k + 37 + sqrt(37^2 + 74 k), by
    Chernoff's bound of the lower tail, so the search has no other limit than k. Terms are summed by
    their logarithms, which large means do not underflow.
    """

    def below(rate: Column) -> Column:
        start = F.struct((-rate).alias("log"), F.exp(-rate).alias("total"))
        return F.aggregate(
            F.filter(F.sequence(F.lit(0), k - 1), lambda i: i > 0), start,
            lambda a, i: F.struct((a["log"] + F.log(rate) - F.log(i)).alias("log"), (a["total"] + F.exp(a["log"] + F.log(rate) - F.log(i))).alias("total")),
            lambda a: a["total"],
        )

    def halve(a: Column, _: Column) -> Column:
        middle = (a["lo"] + a["hi"]) / 2
        return F.when(below(middle) > u, F.struct(middle.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle.alias("hi")))

    top = (k + 37 + F.sqrt(F.lit(37.0 * 37) + 74 * k)).cast("double")
    halved = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("lo"), top.alias("hi")), halve, lambda a: a["hi"])
    return F.when(k == 1, -F.log(u)).otherwise(halved)  # P(X < 1) = exp(-rate)


def sized_documents(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the documents whose source has a target, written once."""
    # few rows per source; not broadcast by hint, the planner knows their size
    wanted = targets.where(F.col("source").isNotNull()).select("source").distinct()
    rows = documents.select("doc_id", "source", "text").join(wanted, "source", "left_semi")
    return materialise(token_count(spread(rows), "doc_id", "text", keep=("source",), folder=folder, vocabulary=vocabulary))


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | str | None = None) -> DataFrame:
    """``(source, weight, max_repeats, available, goal)``: the tokens that each source should give.

    Weights are taken relative to those of all sources that have documents. Without
    ``total_tokens`` the mixture is as large as it can be with every one of these sources at its
    weight: the source with the least room for its weight is used up to its cap. With a larger
    total, or ``"available"`` for as many tokens as the documents of all these sources have, a source whose share is more than ``max_repeats`` times its tokens gives what it can, and
    the others keep their weights among themselves for the rest, again and again until none is
    short. Null or negative weights and repeats count as 0; of several rows for a source the largest
    weight holds.
    """
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))).alias("t"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    base = t.join(have, "source", "left").select("source", "t.weight", "t.max_repeats", F.coalesce("available", F.lit(0)).alias("available"))
    whole = Window.partitionBy()  # one row per source of the target table
    room = F.col("available") * F.col("max_repeats")
    usable = F.when(room > 0, F.col("weight")).otherwise(0.0)
    p = base.withColumn("room", room).withColumn("w", usable)
    # water filling: in order of room per weight the level at which a source is full is known
    order = Window.partitionBy().orderBy("fill", "source")
    p = p.withColumn("fill", F.when(F.col("w") > 0, F.col("room") / F.col("w")))
    given = F.sum(F.when(F.col("w") > 0, F.col("available"))).over(whole).cast("double") if total_tokens == "available" else F.lit(total_tokens).cast("double")
    p = p.withColumn("total", given if total_tokens is not None else F.min("fill").over(whole) * F.sum("w").over(whole))
    p = p.withColumn("full_before", F.coalesce(F.sum(F.when(F.col("fill").isNotNull(), F.col("room")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    p = p.withColumn("w_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    p = p.withColumn("level", F.when(F.col("fill").isNotNull(), (F.col("total") - F.col("full_before")) / F.col("w_left")))
    # the water level: that of the first source, in this order, which is not full at it
    level = F.min(F.when(F.col("level") <= F.col("fill") * (1 + 1e-12), F.struct("fill", "level"))).over(whole)["level"]
    goal = F.when(F.col("w") <= 0, 0.0).otherwise(F.least(F.col("room").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("w")))
    return p.select("source", "weight", "max_repeats", "available", goal.alias("goal"))


def _copies(sized: DataFrame, targets_plan: DataFrame, seed: int) -> DataFrame:
    """Every allowed copy with the step of the rate at which it enters."""
    u = _uniform(F.col("doc_id"), seed)
    named = targets_plan.where("goal > 0").select("source", "max_repeats", "goal")
    few = named.count() <= MOST_SENT
    # sent to the documents, so that these stay spread as they are, whatever the share of a source
    rows = sized.where(F.col("n_tokens") > 0).join(F.broadcast(named) if few else named, "source")
    rows = rows.select("doc_id", "source", "n_tokens", "goal", u.alias("u"), F.explode(F.sequence(F.lit(1), F.col("max_repeats"))).alias("copy"))
    rate = _entry_rate(F.col("u"), F.col("copy"))
    # steps even in rate / (rate + 2): fine where most copies enter, and never running out
    return rows.withColumn("rate", rate).withColumn("step", F.floor(F.col("rate") / (F.col("rate") + 2) * RATE_STEPS)).drop("u", "rate")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, seed: int = SEED, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """``(chosen, shares)``.

    ``chosen(doc_id, source, copy, n_tokens, shuffle_key)`` has one row per chosen copy, spread over
    the cluster by a random key; in its order the mixture is globally shuffled. ``shares(source,
    weight, max_repeats, n_available, n_goal, n_tokens, n_documents, most_repeats, share)`` reports
    every source of the target table, also those without documents, with the share reached.
    Documents whose source has no target, and texts without tokens, are not in the mixture. Ties
    enter together; the step is settled by the document's hash, so the goal is met to a few texts.
    """
    sized = sized_documents(documents, targets, folder, vocabulary)
    p = materialise(plan(sized, targets, total_tokens))
    copies = materialise(_copies(sized, p, seed))
    level = Window.partitionBy("source").orderBy("step")  # at most RATE_STEPS + 1 rows a source
    steps = copies.groupBy("source", "step", "goal").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("copies")).withColumn("until", F.sum("n").over(level))
    # take whole steps up to the goal, and of the step that crosses it the part that is missing; a
    # single copy is taken if that comes nearer to the goal
    missing = F.greatest(F.lit(0.0), (F.col("goal") - (F.col("until") - F.col("n"))) / F.col("n"))
    cut = steps.select("source", "step", F.when(F.col("until") <= F.col("goal"), 1.0).when(F.col("copies") == 1, F.round(missing)).otherwise(missing).alias("part"))
    taken = copies.join(cut, ["source", "step"]).where((F.col("part") >= 1) | (_uniform(F.concat_ws(":", "doc_id", "copy"), seed + 1) < F.col("part")))
    chosen = taken.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_tokens", F.xxhash64(F.lit(seed), "doc_id", "copy").alias("shuffle_key"))
    per_doc = taken.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("times"))
    got = per_doc.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_documents"), F.max("times").alias("most_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    shares = p.join(got, "source", "left").select(
        "source", "weight", F.col("max_repeats").cast("int").alias("max_repeats"), zero("available").alias("n_available"), F.round("goal").cast("bigint").alias("n_goal"), zero("n_tokens").alias("n_tokens"), zero("n_documents").alias("n_documents"), zero("most_repeats").alias("most_repeats")
    )
    return chosen, shares.withColumn("share", F.coalesce(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(Window.partitionBy())), F.lit(0.0)))
