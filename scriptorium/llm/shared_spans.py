"""Long stretches of words that stand in more than one work.

Method: the stream of a work is cut into overlapping paragraphs of the least length (12 words, that
is 8 shingles, one paragraph starting at every word). The banding is tuned to full recall: one band
of one MinHash, the least shingle hash of the paragraph, so paragraphs of equal words collide with
certainty. Neighbouring paragraphs mostly share the place of their least shingle, and only these
places are shuffled to find collisions. Colliding paragraphs are verified exactly (the shingles that
hold their words are equal, in order), not pair by pair but by grouping on them, and what overlaps
is clustered into maximal runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import map_batches, materialise, whole_groups

#: Words of the shortest shared stretch, and of a shingle of the table.
LEAST_WORDS = 12
SHINGLE_WORDS = 5
#: Words of a work that one task's group holds; longer works are cut there, with an overlap.
BLOCK_WORDS = 1 << 16


def _cover(least_words: int) -> list[int]:
    """Places of the shingles that together hold all words of a paragraph."""
    last = least_words - SHINGLE_WORDS
    return sorted({*range(0, last, SHINGLE_WORDS), last})


def _streams(rows: DataFrame, length: int) -> DataFrame:
    """``rows(work_id, tok_offset, hash)`` in blocks of a work's offsets, each block with the first
    rows of the next, its rows together and in order; so a work with a third of all rows is spread
    over many tasks. Rows without hash are marks."""
    block = F.floor(F.col("tok_offset") / BLOCK_WORDS)
    into = F.when((F.pmod("tok_offset", F.lit(BLOCK_WORDS)) < length - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    cut = rows.select("work_id", F.explode(into).alias("block"), "tok_offset", "hash")
    return cut.repartition("work_id", "block").sortWithinPartitions("work_id", "block", "tok_offset", F.asc_nulls_last("hash"))


class Block:
    """The offsets of whole blocks as arrays, each offset once, and the paragraphs of ``length``
    shingles that begin at them."""

    def __init__(self, table, length: int, block_words: int) -> None:
        import numpy as np

        hashes = table.column("hash").combine_chunks()
        work, block, offset = (table.column(c).to_numpy() for c in ("work_id", "block", "tok_offset"))
        mark = hashes.is_null().to_numpy(zero_copy_only=False)
        value = hashes.fill_null(0).to_numpy()
        new = np.ones(len(work), bool)  # the first row of an offset has its least hash
        new[1:] = (work[1:] != work[:-1]) | (block[1:] != block[:-1]) | (offset[1:] != offset[:-1])
        self.first, self.value, self.mark = np.flatnonzero(new), value, mark
        self.size = np.diff(self.first, append=len(work))
        self.work, self.block, self.offset, self.lo = work[new], block[new], offset[new], value[new]
        # rows of an offset that are neither repeats nor marks, beyond the first
        further = ~new & ~mark
        further[1:] &= value[1:] != value[:-1]
        n = len(self.first)
        at = np.cumsum(new) - 1
        self.extra = np.bincount(at[further], minlength=n)
        self.marked = np.bincount(at[mark], minlength=n) > 0
        end = np.minimum(np.arange(n) + length - 1, n - 1)
        same = (self.work[end] == self.work) & (self.block[end] == self.block)
        self.whole = same & (self.offset[end] == self.offset + length - 1) & (self.offset // block_words == self.block)
        self.least = np.arange(n)
        for k in range(1, length):
            at_k = np.minimum(np.arange(n) + k, n - 1)
            self.least = np.where(self.lo[at_k] < self.lo[self.least], at_k, self.least)
        self.length = length

    def within(self, values, before: int):
        """Sum of ``values`` from ``before`` places back to the end of each place's paragraph."""
        import numpy as np

        run = np.concatenate([[0], np.cumsum(values)])
        n = len(values)
        return run[np.minimum(np.arange(n) + self.length, n)] - run[np.maximum(np.arange(n) - before, 0)]

    def hashes(self, k: int) -> list[int]:
        rows = slice(self.first[k], self.first[k] + self.size[k])
        return sorted(set(self.value[rows][~self.mark[rows]].tolist()))


def _bands(length: int, block_words: int):
    """Batches of (work_id, place, band): where the least shingles of paragraphs lie. Near an offset
    with several hashes, each of which may belong to another paragraph, all hashes are put up."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for table in whole_groups(batches, 2):
            b = Block(table, length, block_words)
            at = np.unique(b.least[b.whole & (b.within(b.extra, 0) == 0)])
            odd = [(k, h) for k in np.flatnonzero(b.within(b.extra, length - 1) > 0).tolist() for h in b.hashes(k)]
            more = np.array([k for k, _ in odd], np.int64)
            columns = [np.concatenate([x[at], x[more]]) for x in (b.work, b.offset)] + [np.concatenate([b.lo[at], np.array([h for _, h in odd], np.int64)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["work_id", "place", "band"])

    return run


def _marked(length: int, at: list[int], block_words: int):
    """Batches of (work_id, tok_offset, s0, s5..): the paragraphs whose least shingle is marked, those
    with an offset of several hashes in every combination if any of their offsets is."""

    def run(batches: Iterator) -> Iterator:
        import itertools

        import numpy as np
        import pyarrow as pa

        names = ["work_id", "tok_offset", *[f"s{k}" for k in at]]
        for table in whole_groups(batches, 2):
            b = Block(table, length, block_words)
            several = b.within(b.extra, 0) > 0
            p = np.flatnonzero(b.whole & ~several & b.marked[b.least])
            columns = [b.work[p], b.offset[p], *[b.lo[p + k] for k in at]]
            odd = [(int(b.work[k]), int(b.offset[k]), *x) for k in np.flatnonzero(b.whole & several & (b.within(b.marked, 0) > 0)).tolist() for x in itertools.product(*[b.hashes(k + j) for j in at])]
            more = np.array(odd, np.int64).reshape(len(odd), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c, more[:, k]])) for k, c in enumerate(columns)], names=names)

    return run


def colliding_paragraphs(shingle: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(work_id, tok_offset, s0, s5..)``: the paragraphs of which the band stands in another work
    too, by the place of their first word, with the shingles that hold their words.

    Repeated rows count once. An offset that has several hashes stands for each of them, in every
    combination. A paragraph with a missing shingle does not exist.
    """
    n, at = least_words - SHINGLE_WORDS + 1, _cover(least_words)
    rows = shingle.where(F.col("hash").isNotNull() & F.col("work_id").isNotNull() & F.col("tok_offset").isNotNull()).select("work_id", "tok_offset", "hash")
    places = map_batches(_streams(rows, n), _bands(n, BLOCK_WORDS), "work_id bigint, place bigint, band bigint")
    bands = places.groupBy("band").agg(F.min("work_id").alias("lo"), F.max("work_id").alias("hi")).where(F.col("lo") != F.col("hi")).select("band")
    marks = places.join(bands, "band", "left_semi").select("work_id", F.col("place").alias("tok_offset"), F.lit(None).cast("bigint").alias("hash"))
    return map_batches(_streams(rows.unionByName(marks), n), _marked(n, at, BLOCK_WORDS), "work_id bigint, tok_offset bigint, " + ", ".join(f"s{k} bigint" for k in at))


def _runs(starts: DataFrame, length: int) -> DataFrame:
    """Maximal runs of offsets covered by stretches of ``length`` words at ``tok_offset``.

    First within blocks of offsets; only runs that come near an end of their block, a few for each
    block, are then put together along the work.
    """

    def merge(df: DataFrame, *keys: str) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy("a", "b")
        reach = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
        marked = df.withColumn("reach", reach).withColumn("n", F.sum(F.when(F.col("a") <= F.col("reach") + 1, 0).otherwise(1)).over(by))
        return marked.groupBy(*keys, "n").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("n")

    spans = starts.select("work_id", F.floor(F.col("tok_offset") / BLOCK_WORDS).alias("block"), F.col("tok_offset").alias("a"), (F.col("tok_offset") + length - 1).alias("b"))
    inside = materialise(merge(spans, "work_id", "block"))
    edge = (F.col("a") <= F.col("block") * BLOCK_WORDS + length) | (F.col("b") >= (F.col("block") + 1) * BLOCK_WORDS - 1)
    return inside.where(~edge).select("work_id", "a", "b").unionByName(merge(inside.where(edge).drop("block"), "work_id").select("work_id", "a", "b"))


def shared_runs(shingle: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(work_id, tok_first, tok_last)``: the longest runs of words of each work that lie in
    stretches of ``least_words`` or more words standing also in another work.

    Repeats inside one work alone do not count. No pairs are formed: a stretch that stands in a
    third of all works costs one row for each place. Rows with a null column are left out, repeated
    rows count once, extra columns are ignored, an empty table gives nothing, a work shorter than
    ``least_words`` words has no run.
    """
    colliding = materialise(colliding_paragraphs(shingle, least_words))
    seq = [f"s{k}" for k in _cover(least_words)]
    elsewhere = colliding.groupBy(*seq).agg(F.min("work_id").alias("lo"), F.max("work_id").alias("hi")).where(F.col("lo") != F.col("hi")).select(*seq)
    verified = colliding.join(elsewhere, seq, "left_semi")
    runs = _runs(verified, least_words)
    return runs.select("work_id", F.col("a").cast("bigint").alias("tok_first"), F.col("b").cast("bigint").alias("tok_last"))


def shared_shares(shingle: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(work_id, n_words, n_shared, share, n_runs)``: how much of each work stands elsewhere.

    The words of a work are those its shingles cover. Works without a shared run have share 0.
    """
    total = shingle.where(F.col("hash").isNotNull() & F.col("tok_offset").isNotNull()).groupBy("work_id").agg((F.max("tok_offset") + SHINGLE_WORDS).alias("n_words"))
    runs = shared_runs(shingle, least_words).groupBy("work_id").agg(F.sum(F.col("tok_last") - F.col("tok_first") + 1).alias("n_shared"), F.count("*").alias("n_runs"))
    out = total.join(runs, "work_id", "left")
    shared = F.coalesce("n_shared", F.lit(0))
    return out.select("work_id", F.col("n_words").cast("bigint").alias("n_words"), shared.cast("bigint").alias("n_shared"), (shared / F.col("n_words")).alias("share"), F.coalesce("n_runs", F.lit(0)).cast("bigint").alias("n_runs"))
