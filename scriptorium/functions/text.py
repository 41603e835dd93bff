"""Word-level text normalisation as JVM column expressions (no Python in the data path)."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of the word n-grams of the passage index.
SHINGLE_WORDS = 5


@functools.cache
def base_letter_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: every letter whose canonical decomposition is one
    of a-z plus marks goes to that letter; j and v go to i and u. Built from the Unicode data."""
    src, dst = [], []
    for cp in range(0x80, 0x2100):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch.lower()) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and "a" <= base <= "z":
            src.append(ch)
            dst.append({"j": "i", "v": "u"}.get(base, base))
    return "".join(src) + "jvJV", "".join(dst) + "iuiu"


def normalised(text: Column) -> Column:
    """The text as lower-case a-z words separated by blanks, archaic spellings levelled.

    Case, marks, j/v, ligatures and punctuation disappear; *uol-*, *-uom/-uos* are respelt, in this
    order: ``uo`` before l + consonant at a word start, ``uo`` before a final m or s inside a word,
    then the words quom and quoi. Null stays null.
    """
    src, dst = base_letter_table()
    t = F.lower(F.translate(text, src, dst))
    rest = F.replace(F.replace(t, F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    # only what is more than one byte a letter needs the other steps
    t = F.regexp_replace(F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(rest, r"\p{Mn}+", "")), "[^a-z]+", " ")
    old = F.regexp_replace(t, r"\buo(l[ntgpc])", "uu$1")
    old = F.regexp_replace(old, r"(?<=[a-z])uo([ms])\b", "uu$1")
    old = F.regexp_replace(F.regexp_replace(old, r"\bquom\b", "cum"), r"\bquoi\b", "cui")
    return F.when(F.contains(t, F.lit("uo")), old).otherwise(t)


def words(text: Column) -> Column:
    """``normalised`` as an array of words; null and wordless texts give an empty array."""
    t = F.trim(normalised(text))  # single blanks between words, so only the ends need care
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(t == "", none).otherwise(F.split(t, " ")), none)


def shingles(word_array: Column, n: int = SHINGLE_WORDS) -> Column:
    """All runs of ``n`` consecutive words, each joined by blanks; fewer than n words give none."""
    # a one-element array binds the words, so that they are not made anew for each run
    runs = lambda w: F.when(
        F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(word_array), runs), F.lit(0))


#: Every white space character.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def strip_blanks(text: Column) -> Column:
    """The text without outer white space of any kind; null stays null."""
    return F.btrim(text, F.lit(BLANKS))
