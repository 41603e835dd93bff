"""Records that share most of their words, across a collection too large for pairwise comparison.

Two records are linked if their words in common, counted with repeats and in any order, are at
least ``share`` of the words of the longer one.

Method: size-banded tiles with hashed bitmap signatures. Records of equal words are one class. Each
class goes to tiles named by the rarest words it must share with any partner (a prefix under one
global order of the words, its length set by the size band of possible partners); within a tile
sizes and hashed bitmaps bound the overlap from above, and only pairs that pass meet the exact
intersection of the sorted word arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import materialise
from .visual import plain_text

#: Share of the longer record's words; numerator and denominator.
SHARE = (3, 4)
LEAST_WORDS = 5
#: Buckets of the word-frequency table that orders words; fixed, so its size has a bound.
FREQUENCY_BUCKETS = 1 << 16
#: Longs of the bitmap of a record; even, as it is folded for short records.
BITMAP_WORDS = 4
#: Records up to this many words go to tiles of two shared words, longer ones to tiles of one.
PAIR_TILE_WORDS = 28


def _needed(n: Column) -> Column:
    """Least overlap with a partner of ``n`` words or fewer: the share of n, rounded up."""
    return F.ceil(n * SHARE[0] / SHARE[1]).cast("int")


def _frequencies(classes: DataFrame) -> Column:
    """Array of FREQUENCY_BUCKETS counts, as a scalar subquery: how many classes use a word of each
    bucket. Any order of words gives the same result; this one makes tiles small."""
    counts = classes.select(F.explode(F.array_distinct("words")).alias("w")).groupBy(F.pmod(F.xxhash64("w"), F.lit(FREQUENCY_BUCKETS)).alias("bucket")).count()
    every = classes.sparkSession.range(FREQUENCY_BUCKETS).select(F.col("id").alias("bucket")).join(counts, "bucket", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("count", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("f")).scalar()


def word_classes(df: DataFrame, record: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: ``members(record, class)`` and ``classes(class, words)``.

    Records of the same words, counted with repeats, form a class, named by its least record id.
    Records of fewer than LEAST_WORDS words (null and empty texts among them) belong to none.
    """
    rows = df.where(F.col(f"`{record}`").isNotNull()).select(F.col(f"`{record}`").alias("record"), plain_text(F.col(f"`{text}`")).alias("t"))
    # one projection a step, so that each is compiled and none is made twice; sort_array, other than
    # array_sort, does not take its projection out of the compiled code
    rows = rows.select("record", F.sort_array(words(F.col("t"))).alias("w"))
    # the test sits in the generator: as a filter it would be pushed down and make the words twice
    bags = rows.select("record", F.explode(F.filter(F.array("w"), lambda w: F.size(w) >= LEAST_WORDS)).alias("words"))
    key = [F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2")]
    bags = materialise(bags)
    classes = materialise(bags.groupBy("words").agg(F.min("record").alias("class")))
    # repeated rows fold here, on three numbers a row
    members = bags.select("record", *key).distinct().join(classes.select(*key, "class"), ["k1", "k2"]).select("record", "class")
    return members, classes


def _signatures(classes: DataFrame) -> DataFrame:
    """``(class, n, tokens, b0..b3)``: tokens are 64-bit hashes of (word, how manieth in the record),
    rarest first under one global order; the b's are a bitmap of BITMAP_WORDS * 64 bits, one bit a token.
    """
    bucket = lambda w: (F.pmod(F.xxhash64(w), F.lit(FREQUENCY_BUCKETS)) + 1).cast("int")
    keyed = F.transform("words", lambda w, i: F.struct(F.element_at("freq", bucket(w)).alias("f"), F.xxhash64(w, i - F.array_position("words", w)).alias("h")))
    t = classes.withColumn("freq", _frequencies(classes)).select("class", F.size("words").alias("n"), keyed.alias("keyed"))
    t = t.select("class", "n", F.sort_array("keyed")["h"].alias("tokens"))
    # records that no tile of one token holds need the folded bitmap only
    fold, half = F.floor(F.col("n") * SHARE[1] / SHARE[0]) <= PAIR_TILE_WORDS, BITMAP_WORDS // 2
    of = lambda j, m: F.expr(f"aggregate(tokens, 0L, (a, h) -> a | CASE WHEN shiftrightunsigned(h, 20) % {m} = {j} THEN shiftleft(1L, CAST(shiftrightunsigned(h, 29) & 63 AS INT)) ELSE 0L END)")
    bits = [F.when(fold, of(j, half) if j < half else F.lit(0).cast("bigint")).otherwise(of(j, BITMAP_WORDS)).alias(f"b{j}") for j in range(BITMAP_WORDS)]
    return t.select("class", "n", "tokens", *bits)


def _tiles(signatures: DataFrame) -> DataFrame:
    """``(tile, class, n, b0..)``: a class in each of its tiles.

    A pair with M words in the longer record shares at least ceil(share * M) tokens, so among the
    first n - ceil(share * M) + k tokens of each it shares k, and a tile is named by k of them: by
    two up to PAIR_TILE_WORDS words (of the longer), by one beyond. A record near that border takes
    part in both. The size range of possible partners so sets how many tokens name tiles; it is no
    part of a tile's name. Tokens stay behind, only the bitmap travels, for tiles of two tokens
    folded to half its length.
    """
    n, half = F.col("n"), BITMAP_WORDS // 2
    bits = [F.col(f"b{j}") for j in range(BITMAP_WORDS)]
    folded = [bits[j].bitwiseOR(bits[j + half]) for j in range(half)] + [F.lit(0).cast("bigint")] * half
    head = F.slice("tokens", F.lit(1), F.least(n, n - _needed(n) + 2))
    pairs = lambda h: F.flatten(F.transform(h, lambda a, i: F.transform(F.slice(h, i + 2, F.greatest(F.size(h) - i - 1, F.lit(0))), lambda b: F.xxhash64(a, b))))
    # a record that can only be the shorter of a single-tile pair has a longer partner of > PAIR_TILE_WORDS words
    longer = F.greatest(n, F.lit(PAIR_TILE_WORDS + 1))
    singles = F.transform(F.slice("tokens", F.lit(1), F.least(n, n - _needed(longer) + 1)), lambda a: F.xxhash64(a))
    named = lambda b, tiles: ["class", "n", *[x.alias(f"b{j}") for j, x in enumerate(b)], F.explode(F.array_distinct(tiles)).alias("tile")]
    # as the longer record n decides; as the shorter the longer has up to n * 4/3 words
    of_two = signatures.where(n <= PAIR_TILE_WORDS).select(*named(folded, F.get(F.transform(F.array(head), pairs), F.lit(0))))
    return of_two.unionByName(signatures.where(F.floor(n * SHARE[1] / SHARE[0]) > PAIR_TILE_WORDS).select(*named(bits, singles)))


#: Tokens that two arrays in the order of their values share, by one walk along both.
_SHARED = """aggregate(sequence(1, size(a) + size(b)), named_struct('i', 0, 'j', 0, 'n', 0), (s, _) -> CASE
  WHEN s.i >= size(a) OR s.j >= size(b) THEN s
  WHEN get(a, s.i) = get(b, s.j) THEN named_struct('i', s.i + 1, 'j', s.j + 1, 'n', s.n + 1)
  WHEN get(a, s.i) < get(b, s.j) THEN named_struct('i', s.i + 1, 'j', s.j, 'n', s.n)
  ELSE named_struct('i', s.i, 'j', s.j + 1, 'n', s.n) END).n"""


def class_links(classes: DataFrame) -> DataFrame:
    """``(class_a, class_b, overlap)`` for each pair of linked classes, the smaller id first.

    No link is lost: the tiles are complete, the bitmaps bound from above and the last test is exact
    on the sorted token arrays. Tiles are joined, not gathered, so a tile of common words streams
    through the join and is split by the adaptive skew join; both sides of the join are one shuffle,
    and the token arrays are fetched for both ends of a pair by another.
    """
    signatures = materialise(_signatures(classes))
    tiles = _tiles(signatures)
    need = F.ceil(F.col("a.n") * SHARE[0] / SHARE[1]).cast("int")
    longer_first = (F.col("b.n") < F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.class") < F.col("a.class")))

    def missing(x: str, y: str) -> Column:
        """Bits of one bitmap that the other lacks: each stands for a token not in common."""
        return sum((F.bit_count(F.col(f"{x}.b{j}").bitwiseAND(F.bitwise_not(F.col(f"{y}.b{j}")))) for j in range(BITMAP_WORDS)), F.lit(0))

    fits = longer_first & (F.col("b.n") >= need) & (F.col("a.n") - missing("a", "b") >= need) & (F.col("b.n") - missing("b", "a") >= need)
    close = tiles.alias("a").join(tiles.alias("b"), (F.col("a.tile") == F.col("b.tile")) & fits).select(F.col("a.class").alias("long"), F.col("b.class").alias("short")).distinct()
    ends = close.select("long", "short", F.explode(F.array("long", "short")).alias("class")).join(signatures.select("class", F.sort_array("tokens").alias("tokens")), "class")
    of = lambda c: F.max(F.when(F.col("class") == F.col(c), F.col("tokens")))
    both = ends.groupBy("long", "short").agg(of("long").alias("a"), of("short").alias("b")).withColumn("overlap", F.expr(_SHARED))
    found = both.where(F.col("overlap") >= F.ceil(F.size("a") * SHARE[0] / SHARE[1]))
    return found.select(F.least("long", "short").alias("class_a"), F.greatest("long", "short").alias("class_b"), "overlap")


def near_duplicate_groups(df: DataFrame, record: str, text: str) -> DataFrame:
    """One row per record of LEAST_WORDS words or more: ``record, class, class_size, links``.

    ``links`` counts the linked records outside the record's class; inside it all are equal.
    """
    members, classes = word_classes(df, record, text)
    members = materialise(members)
    links = materialise(class_links(classes))
    sizes = members.groupBy("class").agg(F.count("*").alias("size"))
    both = links.select(F.col("class_a").alias("class"), F.col("class_b").alias("other")).union(links.select(F.col("class_b"), F.col("class_a")))
    count = both.join(sizes.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("size").alias("links"))
    per_class = sizes.join(count, "class", "left").select("class", F.col("size").alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(per_class, "class").select("record", "class", "class_size", "links")


def near_duplicate_pairs(df: DataFrame, record: str, text: str) -> DataFrame:
    """``(record_a, record_b)``: each linked pair of records, the smaller id first, equal texts
    among them. The output holds every pair; use :func:`near_duplicate_groups` where copies are
    many. Null ids, null, empty and short texts have no pairs; extra columns are ignored.
    """
    members, classes = word_classes(df, record, text)
    members = materialise(members)
    links = class_links(classes)
    a = members.select(F.col("record").alias("a"), F.col("class").alias("class_a"))
    b = members.select(F.col("record").alias("b"), F.col("class").alias("class_b"))
    across = links.join(a, "class_a").join(b, "class_b").select("a", "b")
    inside = a.join(b, (F.col("class_a") == F.col("class_b")) & (F.col("a") < F.col("b"))).select("a", "b")
    return across.union(inside).select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b"))
