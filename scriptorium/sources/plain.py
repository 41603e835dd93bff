"""A library of plain text files, and annotated text in CoNLL-U."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



MARKER = r"\[\s*(\d{1,4})\s*\]"
# Folders of the authors that are indexed by default, authors of files outside such
# folders by the beginning of the file name, names shown instead of folder names, files that are no
# texts, longest title, longest unit text that is stored.
AUTHORS = (
    "caesar", "cicero", "vergil", "ovid", "horace", "catullus", "livy", "tacitus", "sallust", "lucretius", "juvenal", "martial", "seneca", "propertius", "tibullus", "persius", "lucan", "statius",
    "plautus", "terence", "quintilian", "pliny", "suetonius", "nepos", "curtius", "apuleius", "gellius", "ammianus", "columella", "varro", "vitruvius", "frontinus", "justin", "florus", "valeriusmaximus", "sen",
)
ROOT_FILES = {
    "sall": "Sallust", "prop": "Propertius", "tib": "Tibullus", "pers": "Persius", "quintilian": "Quintilian", "manilius": "Manilius", "silius": "Silius Italicus",
    "valeriusflaccus": "Valerius Flaccus", "germanicus": "Germanicus",
}
SHOWN_NAMES = {"sen": "Seneca", "vergil": "Vergil", "livy": "Livy", "sall": "Sallust", "valeriusmaximus": "Valerius Maximus", "curtius": "Curtius Rufus"}
SKIPPED = ("index", "contents", "readme", "license")
TITLE_LENGTH, STORED_LENGTH = 90, 400


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``(path, raw)`` of the files below a folder whose name fits."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def read_library(spark: SparkSession, folder: str, **choice) -> DataFrame:
    """The :func:`library_units` of every text file below ``folder``."""
    return library_units(text_files(spark, folder), **choice)


def library_units(files: DataFrame, authors: list[str] | None = None, prefixes: dict[str, str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """``(path, author, title, seq, ref, leaf, text)`` of ``files(path, raw)``.

    ``authors`` are the folders to take (all, if none are named), ``prefixes`` authors by the first
    part of a file's name, ``names`` what is shown for a folder.

    Lines of more than two words are content, the first of them the heading. Where ``[ n ]`` marks
    chapters, a unit is a chapter (leaf 1); text before the first mark is left out. Elsewhere each
    line is a unit, without path. The title is the first of the first six lines that is longer than
    three signs and no number, else the file name; the author is the folder's name. Sorting within a
    file is by line, the only order a text has; a file is gathered whole.
    """
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    f = files.select("path", "raw").where(~F.lower(name).isin(*SKIPPED))
    lines = F.transform(F.split("raw", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " ")))
    f = f.select("path", "raw", name.alias("name"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("author"), lines.alias("lines"))
    by_prefix = F.lit(None).cast("string")
    for prefix, author in (prefixes or {}).items():
        by_prefix = F.when(F.startswith("name", F.lit(f"{prefix}.")), author).otherwise(by_prefix)
    if authors is not None:
        f = f.where(F.col("author").isin(*authors) | by_prefix.isNotNull())
    shown = F.col("author")
    for folder_name, display in (names or {}).items():
        shown = F.when(F.col("author") == folder_name, display).otherwise(shown)
    f = f.withColumn("author", F.coalesce(by_prefix, shown))
    title = F.filter(F.slice("lines", 1, 6), lambda x: (F.length(x) > 3) & ~x.rlike(r"^\d+$"))
    f = f.withColumn("title", F.left(F.coalesce(F.get(title, F.lit(0)), F.col("name")), F.lit(TITLE_LENGTH)))
    content = F.filter("lines", lambda x: F.size(F.split(x, " ")) > 2)
    f = f.withColumn("content", F.slice(content, 2, F.greatest(F.size(content) - 1, F.lit(0))))
    text = F.array_join("content", " ")
    # chapters: cut the joined text in front of each mark
    pieces = F.filter(F.split(F.regexp_replace(text, MARKER, "\x01$1\x02"), "\x01"), lambda x: F.contains(x, F.lit("\x02")))
    chapters = F.filter(F.transform(pieces, lambda p: F.struct(F.substring_index(p, "\x02", 1).alias("ref"), F.lit(1).alias("leaf"), F.trim(F.substring_index(p, "\x02", -1)).alias("text"))), lambda u: (u["text"] != "") & (u["ref"] != "0"))
    single = F.transform("content", lambda x, i: F.struct(F.lit("").alias("ref"), (i + 1).alias("leaf"), x.alias("text")))
    units = F.when(F.size(chapters) > 0, chapters).otherwise(single)
    return f.select("path", "author", "title", F.posexplode(units).alias("seq", "u")).select("path", "author", "title", "seq", "u.ref", "u.leaf", "u.text")


def stored_form(units: DataFrame) -> DataFrame:
    """Units as the index stores them: texts cut to STORED_LENGTH characters (offsets are counted
    on the whole text before)."""
    return units.withColumn("text", F.left("text", F.lit(STORED_LENGTH)))


def read_conllu(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of CoNLL-U files in the engine's token schema: one document a file (its id a hash of
    the path), sentences and tokens numbered from 0; ranges and empty nodes are left out."""
    f = text_files(spark, folder, "*.conllu")
    return conllu_tokens(f.select(F.xxhash64("path").alias("doc_id"), "raw"))


def conllu_tokens(f: DataFrame) -> DataFrame:
    """The tokens of ``f(doc_id, raw)``; null and empty texts have none."""
    s = f.select("doc_id", F.posexplode(F.filter(F.split("raw", r"\r?\n\s*\r?\n"), lambda x: x.rlike(r"(?m)^\d+\t"))).alias("sent_id", "block"))
    t = s.select("doc_id", F.col("sent_id").cast("bigint").alias("sent_id"), F.explode(F.filter(F.split("block", r"\r?\n"), lambda x: x.rlike(r"^\d+\t"))).alias("line"))
    c = F.split("line", "\t")
    i = F.get(c, F.lit(0)).cast("int") - 1
    head = F.get(c, F.lit(6)).try_cast("int") if hasattr(F.col("x"), "try_cast") else F.get(c, F.lit(6)).cast("int")
    feats = F.get(c, F.lit(5))
    misc = F.get(c, F.lit(9))
    return t.select(
        "doc_id", "sent_id", i.alias("i"), F.get(c, F.lit(1)).alias("text"), F.get(c, F.lit(2)).alias("lemma"), F.get(c, F.lit(3)).alias("pos"),
        F.when(head == 0, "ROOT").otherwise(F.get(c, F.lit(7))).alias("dep"), F.when(F.coalesce(head, F.lit(0)) == 0, i).otherwise(head - 1).alias("head"),
        F.when(feats.isNull() | (feats == "_"), F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(feats, F.lit("\\|"), F.lit("="))).alias("morph"),
        F.array().cast("array<map<string,string>>").alias("candidates"), F.regexp_extract(F.coalesce(misc, F.lit("")), r"(?:^|\|)NER=([^|]*)", 1).alias("ent"), F.regexp_extract(F.coalesce(misc, F.lit("")), r"(?:^|\|)Gloss=([^|]*)", 1).alias("gloss"),
    )
