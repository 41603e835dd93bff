"""Queries of the readers: the tables are written as TEI, plain library or CoNLL-U text and read back.

The files are rows (path, raw), made of blocks of a work's places so that none grows with the data;
the SQL tells from the tables alone what must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.refs import plain_ref
from ..sources import plain, tei
from ..sources.surrogate import annotation_sql
from .queries import PLAIN_REF_SQL, tokens_of

#: Places, notes and tokens of one file.
FILE_ROWS = 200
VERSE, PROSE = tei.Edition("verse", "/verse.xml", ("book",)), tei.Edition("prose", "/prose.xml", ("book",), False, ("chapter", "section"))
LINES, POEMS = tei.Commentary("lines", "A", "w", "la", "/lines.xml"), tei.Commentary("poems", "A", "w", "la", "/poems.xml", ("book", "poem"))
WORDS = tei.Commentary("words", "A", "w", "la", "/words.xml", ("book", "chapter"), "lemma-prose")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _file(rows: DataFrame, path: Column, order: list[str], piece: Column, begin: str, end: str) -> DataFrame:
    """Files of the pieces of one path, in order."""
    g = rows.select(path.alias("path"), F.struct(*order, piece.alias("piece")).alias("x")).groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("path", F.concat(F.lit(begin), F.array_join(F.transform("xs", lambda x: x["piece"]), ""), F.lit(end)).alias("raw"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = _table(spark, sf_dir, "loc").where("leaf IS NOT NULL AND text IS NOT NULL")
    return loc.select("loc_id", "work_id", plain_ref(F.col("ref")).alias("ref"), "leaf", "text", F.floor(F.col("loc_id") / FILE_ROWS).alias("part"))


def source_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places cited by one number as verse, by two as prose between milestones."""
    p = _places(spark, sf_dir)
    verse = p.where(p.ref.rlike("^[0-9]+$"))
    line = F.concat(F.lit('<l n="'), "leaf", F.lit('">'), _escaped(F.col("text")), F.lit("</l>"))
    prose = p.where(p.ref.rlike("^[0-9]+[.][0-9]+$"))
    place = lambda unit, n: F.concat(F.lit(f'<milestone unit="{unit}" n="'), n, F.lit('"/>'))
    section = F.concat(place("chapter", F.substring_index("ref", ".", -1)), place("section", F.col("leaf")), _escaped(F.col("text")))
    path = lambda name, book: F.concat_ws("/", "work_id", book, "part", F.lit(name))
    head, tail = "<!DOCTYPE TEI.2><TEI.2><text><body>", "</body></text></TEI.2>"
    one = _file(verse, path("verse.xml", F.col("ref")), ["loc_id"], line, "", "")
    two = _file(prose, path("prose.xml", F.substring_index("ref", ".", 1)), ["loc_id"], section, "", "")
    book = F.split("path", "/")[1]
    files = one.unionByName(two).select("path", F.concat(F.lit(head), F.lit('<div1 type="Book" n="'), book, F.lit('"><p>'), "raw", F.lit("</p></div1>"), F.lit(tail)).alias("raw"))
    units = tei.edition_units(files, [VERSE, PROSE])[0]
    return units.select(F.substring_index("path", "/", 1).cast("bigint").alias("work_id"), "ref", F.col("leaf").cast("bigint").alias("leaf"), "text")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "note").where("text IS NOT NULL")
    return n.select("id", plain_ref(F.col("ref")).alias("ref"), "line_start", "line_end", F.coalesce("lemma", F.lit("")).alias("lemma"), F.coalesce("grammar", F.lit("")).alias("grammar"), "text", F.floor(F.col("id") / FILE_ROWS).alias("part")).where(F.col("ref").rlike("^[0-9]+([.][0-9]+)?$"))


def _divs(ref: Column, inside: Column, second: str) -> Column:
    """A numbered book around the text, and a poem or chapter where the path has a second number."""
    two = F.concat(F.lit(f'<div2 type="{second}" n="'), F.substring_index(ref, ".", -1), F.lit('">'), inside, F.lit("</div2>"))
    return F.concat(F.lit('<div1 type="Book" n="'), F.substring_index(ref, ".", 1), F.lit('">'), F.when(F.contains(ref, F.lit(".")), two).otherwise(inside), F.lit("</div1>"))


def source_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with a first line as elements on lines, their lemma as a capitalised highlight."""
    n = _notes(spark, sf_dir).where("line_start IS NOT NULL")
    span = F.concat("line_start", F.coalesce(F.concat(F.lit("-"), "line_end"), F.lit("")))
    head = F.when(F.col("lemma") != "", F.concat(F.lit('<hi rend="caps">'), _escaped(F.col("lemma")), F.lit("</hi>"))).otherwise("")
    note = F.concat(F.lit('<div3 type="commline" n="'), span, F.lit('"><p>'), head, _escaped(F.col("text")), F.lit("</p></div3>"))
    name = F.when(F.contains("ref", F.lit(".")), "poems.xml").otherwise("lines.xml")
    files = _file(n, F.concat_ws("/", "part", name), ["id"], _divs(F.col("ref"), note, "poem"), "<TEI.2>", "</TEI.2>")
    got = tei.commentary_notes(files, [LINES, POEMS])[0]
    return got.select("ref", F.col("line_start").cast("bigint").alias("line_start"), F.col("line_end").cast("bigint").alias("line_end"), "lemma", "text")


def source_word_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with a lemma and a path of two numbers as notes on words in chapters."""
    n = _notes(spark, sf_dir).where("lemma <> '' AND ref LIKE '%.%'")
    note = F.concat(F.lit("<p><lemma>"), _escaped(F.col("lemma")), F.lit("</lemma> "), _escaped(F.col("text")), F.lit(' <bibl n="'), F.replace(_escaped(F.col("grammar")), F.lit('"'), F.lit("")), F.lit('"/></p>'))
    files = _file(n, F.concat_ws("/", "part", F.lit("words.xml")), ["id"], _divs(F.col("ref"), note, "Chapter"), "<TEI.2>", "</TEI.2>")
    return tei.commentary_notes(files, [WORDS])[0].select("ref", "lemma", "grammar", "text")


def source_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a plain text library under a heading; those of even id have a chapter
    mark before each line."""
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("text", F.translate("text", "[", "("))  # some hold note numbers
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("[ "), i + 1, F.lit(" ] "), x)), "\n")
    raw = F.concat(F.lit("the title of a file\n"), F.when(F.pmod("doc_id", F.lit(2)) == 0, marked).otherwise(F.col("text")))
    got = plain.library_units(d.select(F.concat(F.lit("lib/author/"), "doc_id", F.lit(".txt")).alias("path"), raw.alias("raw")))
    per = got.groupBy("path").agg(F.count("*").alias("n"), F.min("ref").alias("first_ref"), F.sum(F.length("text")).alias("characters"))
    return per.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), "n", "first_ref", "characters")


def source_conllu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in tokens written in CoNLL-U and read back, by part of speech, relation and features."""
    t = tokens_of(spark, sf_dir)
    feats = F.coalesce(F.nullif(F.array_join(F.transform(F.map_entries("morph"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|"), F.lit("")), F.lit("_"))
    head = F.when(F.col("head") == F.col("i"), 0).otherwise(F.col("head") + 1)
    row = F.concat_ws("\t", (F.col("i") + 1).cast("string"), "text", "lemma", "pos", F.lit("_"), feats, head.cast("string"), F.when(F.col("head") == F.col("i"), "root").otherwise(F.col("dep")), F.lit("_"), F.concat(F.lit("NER="), "ent"))
    block = t.groupBy("doc_id", "sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("row")))), lambda x: x["row"]), "\n").alias("raw"))
    files = block.select("sent_id", F.concat(F.lit("# sent\n"), "raw", F.lit("\n\n")).alias("raw")).select(F.col("sent_id").alias("doc_id"), "raw")
    got = plain.conllu_tokens(files)
    return got.groupBy("pos", "dep").agg(F.count("*").alias("n"), F.sum("head").alias("heads"), F.count(F.try_element_at("morph", F.lit("Case"))).alias("with_case"), F.count_if(F.col("ent") != "").alias("entities"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (source_editions, source_notes, source_word_notes, source_library, source_conllu)}


_BLANK = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+"


def _squeezed(text: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({text}), '{_BLANK}', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    ref = PLAIN_REF_SQL.format(ref="ref")
    notes = f"n AS (SELECT id, {ref} AS ref, line_start, line_end, coalesce(lemma, '') AS lemma, coalesce(grammar, '') AS grammar, text FROM note WHERE text IS NOT NULL)"
    repaired = "regexp_replace(regexp_replace(regexp_replace({t}, '\\s+([,.;:!?)\\]])', '\\1', 'g'), '([(\\[])\\s+', '\\1', 'g'), '\\s+''\\s*(.*?)\\s*''', ' ''\\1''', 'g')"
    lemma = f"lower(trim({_squeezed('lemma')}, '[](){{}}.,;:†*'))"
    return {
        "source_editions": f"""WITH p AS (SELECT work_id, {ref} AS ref, leaf, {_squeezed('text')} AS text FROM loc WHERE leaf IS NOT NULL AND text IS NOT NULL)
          SELECT work_id, ref, CASE WHEN ref LIKE '%.%' AND leaf = 0 THEN 1 ELSE leaf END::BIGINT AS leaf, text FROM p WHERE regexp_full_match(ref, '[0-9]+([.][0-9]+)?') AND text <> ''""",
        "source_notes": f"""WITH {notes}, t AS (SELECT ref, line_start, line_end, {lemma} AS lemma, trim({repaired.format(t=f"regexp_replace(CASE WHEN lemma = '' THEN '' ELSE nfc_normalize(lemma) || ' ' END || nfc_normalize(text) || ' ', '{_BLANK}', ' ', 'g')")}) AS text
          FROM n WHERE line_start IS NOT NULL AND regexp_full_match(ref, '[0-9]+([.][0-9]+)?'))
          SELECT ref, line_start::BIGINT AS line_start, coalesce(line_end, line_start)::BIGINT AS line_end, lemma, text FROM t WHERE text <> ''""",
        "source_word_notes": f"""WITH {notes}, t AS (SELECT ref, trim(lower(trim(nfc_normalize(lemma))), ' ,.:') AS lemma, trim(replace(grammar, '"', '')) AS grammar, regexp_replace(' ' || nfc_normalize(text) || ' ', '{_BLANK}', ' ', 'g') AS text FROM n WHERE lemma <> '' AND regexp_full_match(ref, '[0-9]+[.][0-9]+')),
          u AS (SELECT ref, lemma, grammar, regexp_replace(text, '\\s+([,.;:])', '\\1', 'g') AS text FROM t),
          v AS (SELECT ref, lemma, grammar, trim(text, ' ,;:') AS text FROM u)
          SELECT ref, lemma, grammar, text FROM v WHERE lemma <> '' AND length(text) > 2""",
        "source_library": f"""WITH l AS (SELECT doc_id, unnest(string_split(translate(text, '[', '('), chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL),
          s AS (SELECT doc_id, k, trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '[ ' || k || ' ] ' || raw ELSE raw END, '[\\s\\p{{Z}}]+', ' ', 'g')) AS line, trim(regexp_replace(raw, '[\\s\\p{{Z}}]+', ' ', 'g')) AS bare FROM l),
          c AS (SELECT *, doc_id % 2 = 0 AND max(bare <> '') OVER (PARTITION BY doc_id) AS chapters FROM s WHERE len(string_split(line, ' ')) > 2),
          u AS (SELECT doc_id, CASE WHEN chapters THEN k::VARCHAR ELSE '' END AS ref, CASE WHEN chapters THEN bare ELSE line END AS text FROM c)
          SELECT doc_id, count(*) AS n, min(ref) AS first_ref, sum(length(text))::BIGINT AS characters FROM u WHERE text <> '' GROUP BY doc_id""",
        "source_conllu": f"""WITH {annotation_sql()} SELECT pos, dep, count(*) AS n, sum(head)::BIGINT AS heads, count(cas) AS with_case, count(*) FILTER (WHERE ent <> '') AS entities FROM flat0 GROUP BY pos, dep""",
    }
