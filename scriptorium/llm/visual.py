"""One consistent form for text that looks alike but is made of other characters.

Method: texts are taken apart into positioned code points, which meet a decomposition table and a
look-alike table in broadcast joins; combining marks are ordered by class, clusters recomposed and
the strings rebuilt. Only texts that hold a character or a sequence which the tables could change
are taken apart (a quick check, as Unicode's own normal forms have one); all others are already
in the consistent form.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

# Letters of other scripts that look like a Latin letter, each before its twin.
LOOK_ALIKES = (
    # Greek
    "Αa Αa Βb Εe Ζz Ηh Ιi Κk Μm Νn Οo Ρp Τt Υy Χx οo νv αa ιi κk ρp υu τt γy ϲc Ϲc "
    # Cyrillic
    "Аa Вb Еe Ѕs Іi Јj Кk Мm Нh Оo Рp Сc Тt Уy Хx Ԁd Ԛq Ԝw Һh Ӏl Ү у "
    "аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ӏl ѵv кk мm нh тt "
    # Armenian
    "Օo Սs Տs Լl օo ոn սu հh ցg զq յj ք "
    # Coptic
    "Ⲁa Ⲃb Ⲉe Ⲏh Ⲓi Ⲕk Ⲙm Ⲛn Ⲟo Ⲣp Ⲥc Ⲧt Ⲩy Ⲭx ⲟo ⲣp ⲥc ⲭx "
    # Cherokee
    "Ꭰd Ꭱr Ꭲt Ꭵi Ꭺa Ꭻj Ꭼe Ꮃw Ꮇm Ꮋh Ꮍy Ꮐg Ꮓz Ꮢr Ꮩv Ꮪs Ꮮl Ꮯc Ꮲp Ꮶk Ᏼb Ꮟb Ꮷd "
    # Lisu
    "ꓐb ꓑp ꓓd ꓔt ꓖg ꓗk ꓙj ꓚc ꓜz ꓝf ꓟm ꓠn ꓡl ꓢs ꓣr ꓦv ꓧh ꓪw ꓫx ꓬy ꓮa ꓰe ꓲi ꓳo ꓴu "
)
# Letters of the Latin script in small capitals or another cut, each before its plain letter.
OTHER_CUTS = "ᴀa ᴄc ᴅd ᴇe ᴊj ᴋk ᴍm ᴏo ᴘp ᴛt ᴜu ᴠv ᴡw ᴢz ꜱs ɡg"

#: Kinds of compatibility decomposition whose result looks the same, and the ranges in which that
#: holds for those that Unicode calls just <compat>: digraphs, Roman numerals, ligatures, signs.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
SAME_LOOK_RANGES = ((0x132, 0x133), (0x149, 0x149), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x203C, 0x203C), (0x2047, 0x2049), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
#: Characters besides those of category Cf that show nothing: joiners, fillers, variation selectors.
INVISIBLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
#: All planes that hold letters, marks or signs; the rest are ideographs and private use.
CODE_POINTS = ((0x80, 0x33480), (0xE0000, 0xE1000))

MARKS = r"\p{M}"
OTHER_SCRIPTS = r"\p{IsGreek}\p{IsCyrillic}\p{IsArmenian}\p{IsCoptic}\p{IsCherokee}\p{IsLisu}"
#: Scripts into which a word of mixed scripts may fall if it cannot be Latin.
WAYS_BACK = {"greek": r"\p{IsGreek}", "cyrillic": r"\p{IsCyrillic}", "armenian": r"\p{IsArmenian}"}
#: A run of letters, marks and invisible characters: what the eye takes for one word.
WORD = r"[\p{L}\p{M}\p{Cf}]+"


@functools.cache
def look_alikes() -> dict[str, str]:
    """Letter of another script -> Latin letter of the same look and case."""
    pairs = {}
    for x in LOOK_ALIKES.split():
        if len(x) == 2:
            pairs[x[0]] = x[1].upper() if x[0].isupper() else x[1]
    return pairs


@functools.cache
def decompositions() -> tuple[dict[str, str], list[tuple[str, str, int, int]]]:
    """(plain replacements, rows of (character, piece, place, combining class)).

    Replacements: invisible characters go, every space becomes the plain one, full-width and font
    variants, ligatures, digraphs, Roman numerals and small capitals become plain letters. Rows: the full canonical
    decomposition of the replacement of every character that differs from it, and the class of
    every combining mark. The size is bounded by the Unicode character set.
    """
    within = lambda cp, ranges: any(a <= cp <= b for a, b in ranges)
    plain: dict[str, str] = {x[0]: x[1] for x in OTHER_CUTS.split()}
    rows = []
    for cp in (cp for a, b in CODE_POINTS for cp in range(a, b)):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:  # Hangul composes by rule and is left alone
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co") and not within(cp, INVISIBLE):
            continue
        kind = unicodedata.decomposition(ch).split(" ")[0]
        if cat == "Cf" or within(cp, INVISIBLE):
            plain[ch] = ""
        elif cat == "Zs":
            plain[ch] = " "
        elif kind in SAME_LOOK or (kind == "<compat>" and within(cp, SAME_LOOK_RANGES)):
            plain[ch] = unicodedata.normalize("NFKC", ch)
        parts = unicodedata.normalize("NFD", plain.get(ch, ch))
        if parts != ch or unicodedata.combining(ch):
            rows += [(ch, p, k, unicodedata.combining(p)) for k, p in enumerate(parts)] or [(ch, "", 0, 0)]
    return plain, rows


@functools.cache
def composition_pairs() -> str:
    """``pair:composed`` for every canonical primary composite, for ``str_to_map``."""
    out = []
    for cp in range(0xC0, CODE_POINTS[0][1]):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (chr(int(x, 16)) for x in d.split())
            if unicodedata.combining(b):
                out.append(f"{a}{b}\x02{ch}")
    return "\x01".join(out)


@functools.cache
def odd_pattern() -> str:
    """Java pattern of the characters and marks that no text in the consistent form has, but for
    marks without a composed form. The look-ahead lets plain ASCII pass at the cost of one test."""
    plain, rows = decompositions()
    odd = set(plain) | {c for c, *_ in rows if unicodedata.normalize("NFC", c) != c}
    return rf"(?=[^\x00-\x7F])[{MARKS}{_ranges(odd)}]"


@functools.cache
def safe_pattern() -> str:
    """Java pattern of texts of plain Latin letters and the usual signs only, a cheap first test."""
    plain, rows = decompositions()
    odd = set(plain) | {c for c, *_ in rows}
    composed = {c for c in map(chr, (*range(0xA1, 0x180), *range(0x1E00, 0x1F00), *range(0x2010, 0x2028))) if unicodedata.category(c)[0] in "LPS" and (c not in odd or (c not in plain and unicodedata.normalize("NFC", c) == c))}
    return rf"^[\x00-\x7F{_ranges(composed)}]*+$"


#: A letter of one script right beside one of another: every word of mixed scripts without marks and
#: invisible characters has such a place.
OTHERS = r"\u0370-\u03FF\u0400-\u058F\u13A0-\u13FF\u1C80-\u1C8F\u1F00-\u1FFF\u2C80-\u2CFF\u2DE0-\u2DFF\uA4D0-\uA4FF\uA640-\uA69F\uAB70-\uABBF"
LATIN = r"A-Za-z\u00AA-\u024F\u1E00-\u1EFF"
SEAM = f"[{LATIN}][{OTHERS}]|[{OTHERS}][{LATIN}]"


def _ranges(chars: set[str]) -> str:
    cps, out = sorted(map(ord, chars)), []
    for c in cps:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def suspicious(text: Column) -> Column:
    """True where the text may hold a character that plainly typed text would not; null as false.

    Texts of ASCII characters only are told by their length in bytes, those of plain Latin letters
    by one run over them.
    """
    return F.coalesce((F.octet_length(text) != F.length(text)) & ~text.rlike(safe_pattern()) & (text.rlike(odd_pattern()) | text.rlike(SEAM)), F.lit(False))


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(decompositions, look-alikes); both of fixed size, so they are broadcast."""
    _, rows = decompositions()
    by: dict[str, list] = {}
    for ch, piece, k, ccc in rows:
        by.setdefault(ch, []).append((k, piece, ccc))
    d = spark.createDataFrame(list(by.items()), "ch string, pieces array<struct<k:int,piece:string,ccc:int>>")
    there = [(a, "latin", b) for a, b in look_alikes().items()]
    back: dict[tuple[str, str], str] = {}
    for a, b in look_alikes().items():
        if (script := unicodedata.name(a).split()[0].lower()) in WAYS_BACK:
            back.setdefault((script, b), a)
    look = spark.createDataFrame(there + [(b, s, a) for (s, b), a in back.items()], "ch string, script string, twin string")
    return d, look


def _target_script(token: Column) -> Column:
    """The script to which the look-alikes of a word of mixed scripts go; null for other words.

    Latin, if every foreign letter has a Latin twin; else the other script, if each Latin letter
    has a twin there; else null, and the word stays as it is.
    """
    twins = look_alikes()
    of = lambda s: "".join(b for a, b in twins.items() if s in unicodedata.name(a))
    mixed = token.rlike(r"\p{IsLatin}") & token.rlike(f"[{OTHER_SCRIPTS}]")
    out = F.when(~token.rlike(f"[{OTHER_SCRIPTS}&&[^{''.join(twins)}]]"), "latin")
    for name, cls in WAYS_BACK.items():
        letters = of(name.upper())
        out = out.when(token.rlike(cls) & ~token.rlike(rf"[\p{{IsLatin}}&&[^{letters}]]"), name)
    return F.when(mixed, out)


def _key(text: Column) -> list[Column]:
    """A 128-bit key of a text. Rows of single characters carry it instead of the text, which would
    make the work on a text grow as the square of its length."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def canonical_map(texts: DataFrame, text: str) -> DataFrame:
    """``(k1, k2, canonical)`` for each different suspicious value of ``texts[text]``, by its key.

    Values that the tables cannot change, and null, have no row: they are their own form. Empty
    text has none either. A value that occurs in many rows is treated once, and within it only the
    words that may change are taken apart. Very long texts are processed whole; what is gathered at
    once is one text.
    """
    spark = texts.sparkSession
    decomposition, look = _tables(spark)
    col = F.col(f"`{text}`")
    values = texts.where(suspicious(col)).select(*_key(col), col.alias("text")).distinct()
    tokens = values.select("k1", "k2", F.posexplode(F.regexp_extract_all("text", F.lit(f"({WORD}|[^\\p{{L}}\\p{{M}}\\p{{Cf}}]+)"), 1)).alias("t", "token"))
    tokens = tokens.withColumn("script", _target_script(F.regexp_replace("token", r"[\p{Cf}\p{M}]+", "")))
    tokens = tokens.withColumn("apart", F.col("script").isNotNull() | F.col("token").rlike(odd_pattern()))
    # invisible characters go first, so that a mark behind one meets its letter
    seen = F.regexp_replace("token", f"[{_ranges({c for c, b in decompositions()[0].items() if not b})}]+", "")
    parts = F.when(F.col("apart") & (seen != ""), F.regexp_extract_all(seen, F.lit(rf"((?:[^\p{{M}}]|^\p{{M}}){MARKS}*)"), 1)).otherwise(F.array(F.when(F.col("apart"), "").otherwise(F.col("token"))))
    clusters = tokens.select("k1", "k2", "t", "script", "apart", F.posexplode(parts).alias("c", "cluster"))
    points = clusters.select("k1", "k2", "t", "c", "script", F.posexplode(F.when(F.col("apart"), F.split("cluster", "")).otherwise(F.array("cluster"))).alias("p", "ch"))
    points = (
        points.join(F.broadcast(look), ["ch", "script"], "left")
        .withColumn("ch", F.coalesce("twin", "ch"))
        .join(F.broadcast(decomposition), "ch", "left")
        .select("k1", "k2", "t", "c", "p", F.explode(F.coalesce("pieces", F.array(F.struct(F.lit(0).alias("k"), F.col("ch").alias("piece"), F.lit(0).alias("ccc"))))).alias("x"))
        .select("k1", "k2", "t", "c", F.struct((F.col("x.ccc") > 0).alias("mark"), F.col("x.ccc").alias("ccc"), "p", F.col("x.k").alias("k"), F.col("x.piece").alias("piece")).alias("x"))
    )
    cluster = points.groupBy("k1", "k2", "t", "c").agg(F.array_sort(F.collect_list("x")).alias("xs")).withColumn("pairs", F.expr(f"str_to_map('{composition_pairs()}', '\x01', '\x02')"))
    marks = F.filter("xs", lambda x: x["mark"])
    starters = F.array_join(F.transform(F.filter("xs", lambda x: ~x["mark"]), lambda x: x["piece"]), "")
    start = F.struct(starters.alias("head"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(a: Column, m: Column) -> Column:
        """A mark composes with the starter unless an uncomposed mark of its class stands between."""
        joined = F.when((a["rest"] == "") | (a["last"] < m["ccc"]), F.try_element_at(F.col("pairs"), F.concat(F.right(a["head"], F.lit(1)), m["piece"])))
        return F.when(
            joined.isNotNull(), F.struct(F.concat(F.left(a["head"], F.length(a["head"]) - 1), joined).alias("head"), a["rest"].alias("rest"), a["last"].alias("last"))
        ).otherwise(F.struct(a["head"].alias("head"), F.concat(a["rest"], m["piece"]).alias("rest"), m["ccc"].alias("last")))

    composed = F.when(F.size(marks) == 0, starters).otherwise(F.aggregate(marks, start, step, lambda a: F.concat(a["head"], a["rest"])))
    rebuilt = cluster.select("k1", "k2", F.struct("t", "c", composed.alias("s")).alias("x")).groupBy("k1", "k2").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rebuilt.select("k1", "k2", F.array_join(F.transform("xs", lambda x: x["s"]), "").alias("canonical"))


def _mapped(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(suspicious rows with their keys, written once; the consistent form of each key)."""
    k1, k2 = _key(F.col(f"`{text}`"))
    odd = materialise(df.where(suspicious(F.col(f"`{text}`"))).withColumns({"__k1": k1, "__k2": k2}))
    mapped = canonical_map(odd, text).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("canonical").alias("__canonical"))
    return odd, mapped


def changed_values(df: DataFrame, text: str) -> DataFrame:
    """The rows of ``df`` whose text differs from its consistent form, plus ``canonical``.

    Null, empty and already consistent texts give no row; repeated rows come out as often as they
    stand in ``df``; other columns are kept as they are.
    """
    odd, mapped = _mapped(df, text)
    both = odd.join(mapped, ["__k1", "__k2"]).where(F.col(f"`{text}`") != F.col("__canonical"))
    return both.select(*df.columns, F.col("__canonical").alias("canonical"))


def consistent_values(df: DataFrame, text: str) -> DataFrame:
    """All rows of ``df`` plus ``canonical``: the consistent form of the text, null for null."""
    odd, mapped = _mapped(df, text)
    done = odd.join(mapped, ["__k1", "__k2"], "left").select(*df.columns, F.coalesce("__canonical", F.col(f"`{text}`")).alias("canonical"))
    return df.where(~suspicious(F.col(f"`{text}`"))).withColumn("canonical", F.col(f"`{text}`")).unionByName(done)


def plain_text(text: Column) -> Column:
    """The consistent form as far as letters a-z and blanks go, as one column expression.

    For operators that reduce text to plain words: it maps single characters and words of mixed
    scripts as :func:`canonical_map` does and leaves composition aside, which words do not see.
    """
    plain, _ = decompositions()
    one = {a: b for a, b in plain.items() if len(b) == 1 and ord(b) < 0x80}
    gone = "".join(a for a, b in plain.items() if not b and unicodedata.category(a) != "Cn")
    several = {a: b for a, b in plain.items() if len(b) > 1 and b.isascii()}
    twins = look_alikes()
    # a one-element array binds a value, so that no step is made twice
    then = lambda value, step: F.get(F.transform(F.array(value), step), F.lit(0))

    def spelt_out(t: Column) -> Column:
        longer = t
        for a, b in several.items():
            longer = F.replace(longer, F.lit(a), F.lit(b))
        return F.when(t.rlike(f"[{_ranges(set(several))}]"), longer).otherwise(t)

    def word(w: Column) -> Column:
        to = lambda script: F.when(script == "latin", F.translate(w, "".join(twins), "".join(twins.values()))).when(script.isNotNull(), "").otherwise(w)
        return F.when(w.rlike(f"[{OTHER_SCRIPTS}]"), then(_target_script(F.regexp_replace(w, r"[\p{M}]+", "")), to)).otherwise(w)

    def one_script(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(f"({WORD}|[^\\p{{L}}\\p{{M}}\\p{{Cf}}]+)"), 1)
        return F.when(t.rlike(f"[{OTHER_SCRIPTS}]"), F.array_join(F.transform(pieces, word), "")).otherwise(t)

    return F.when(suspicious(text), then(then(F.translate(text, "".join(one) + gone, "".join(one.values())), spelt_out), one_script)).otherwise(text)
