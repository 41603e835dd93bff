"""Named queries over the text tables: words, index, identification, commentary, gate and metre,
with the SQL that answers them independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms
from ..functions.refs import plain_ref
from ..functions.text import base_letter_table, shingles, words
from ..operators import gate, readings, retrieval, scansion
from ..operators.constructions import constructions
from ..session import spread
from ..sources.surrogate import annotate, annotation_sql
from .assemble import Library, admitted, analyse, analyse_texts, confidence_label, ranked_readings, to_sentences
from .grammar_sql import KEPT, KEY, all_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as units: ``doc_id, line_no, text``."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return d


def text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "loc").select("loc_id", F.array_join(words(F.col("text")), " ").alias("words"))


def text_shingles(spark, sf_dir):
    s = spread(table(spark, sf_dir, "loc").select("loc_id", "text")).select("loc_id", F.posexplode(shingles(words(F.col("text")))).alias("i", "shingle"))
    return s.select("loc_id", F.col("i").cast("bigint").alias("i"), "shingle")


def index_offsets(spark, sf_dir):
    o = retrieval.unit_offsets(_lines(spark, sf_dir), "doc_id", "line_no", "text")
    return o.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("n_words").cast("bigint").alias("n_words"), F.col("tok_offset").cast("bigint").alias("tok_offset"))


def index_shingles(spark, sf_dir):
    streams = retrieval.work_streams(_lines(spark, sf_dir), "doc_id", "line_no", "text")
    return retrieval.shingle_rows(streams, "doc_id", "words").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("hash").alias("n_distinct"), F.min("hash").alias("least_hash"), F.max("hash").alias("greatest_hash"))


def passage_identify(spark, sf_dir):
    """Every place's own text fed back as if pasted."""
    loc = table(spark, sf_dir, "loc").withColumn("ref", plain_ref(F.col("ref")))
    got = retrieval.identify(spread(loc.select("loc_id", "text")), "loc_id", "text", table(spark, sf_dir, "shingle"), loc, table(spark, sf_dir, "works"), "codexhall")
    return got.select("loc_id", "work", "author", "title", "unit", "ref", "ref_end", F.col("line_start").cast("bigint").alias("line_start"), F.col("line_end").cast("bigint").alias("line_end"), "confidence", "matched", "possible", "citation")


def locate_units(spark, sf_dir):
    q = table(spark, sf_dir, "shingle").select("work_id", "tok_offset").distinct().withColumn("q", F.concat_ws(":", "work_id", "tok_offset"))
    return retrieval.as_of(q, table(spark, sf_dir, "loc"), "q", "tok_offset").select("q", "unit.tok_offset")


def _requests(spark, sf_dir):
    n = table(spark, sf_dir, "note").where("line_start IS NOT NULL")
    last = F.coalesce("line_end", "line_start")
    return n.select(F.col("id").alias("request"), "work", plain_ref(F.col("ref")).alias("ref"), F.least("line_start", last).alias("first"), F.greatest("line_start", last).alias("last"))


def _plain_loc(spark, sf_dir):
    return table(spark, sf_dir, "loc").withColumn("ref", plain_ref(F.col("ref")))


def canonical_lines(spark, sf_dir):
    got = retrieval.canonical_lines(_requests(spark, sf_dir), _plain_loc(spark, sf_dir), table(spark, sf_dir, "works"))
    return got.groupBy("request").agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max("line").alias("last"), F.count("text").alias("with_text"))


def _plain_notes(spark, sf_dir):
    return table(spark, sf_dir, "note").withColumn("ref", plain_ref(F.col("ref")))


def _places(spark, sf_dir):
    loc = _plain_loc(spark, sf_dir).join(table(spark, sf_dir, "works").select(F.col("id").alias("work_id"), F.col("key").alias("work")), "work_id")
    return loc.where("leaf IS NOT NULL").select("work", "ref", F.col("leaf").alias("line")).distinct().withColumn("request", F.concat_ws("|", "work", "ref"))


def notes_for(spark, sf_dir):
    return retrieval.notes_for(_places(spark, sf_dir), _plain_notes(spark, sf_dir)).select("request", F.col("line").cast("bigint").alias("line"), F.col("rank").cast("bigint").alias("rank"), "id")


def commentary_for(spark, sf_dir):
    spans = _places(spark, sf_dir).groupBy("request", "work", "ref").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    return retrieval.commentary_for(spans, _plain_notes(spark, sf_dir)).select("request", F.col("line").cast("bigint").alias("line"), "id")


def coverage(spark, sf_dir):
    notes = _plain_notes(spark, sf_dir).withColumn("line_end", F.coalesce("line_end", "line_start"))
    return retrieval.coverage(_plain_loc(spark, sf_dir), table(spark, sf_dir, "works"), notes)


def _known(spark, sf_dir):
    return table(spark, sf_dir, "loc").select(F.explode(words(F.col("text"))).alias("word")).distinct()


def gate_assess(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return gate.assess(gate.analysable(docs, "doc_id", "text", _known(spark, sf_dir)), gate.language_scores(docs, "doc_id", "text"), "doc_id")


def gate_unrecognised(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return gate.unrecognised(docs, "doc_id", "text", _known(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("position").cast("bigint").alias("first"), F.max("word").alias("greatest"))


def _tokens(spark, sf_dir):
    return annotate(spread(table(spark, sf_dir, "loc").where("text IS NOT NULL").select("work_id", "loc_id", "text")), "work_id", "loc_id", "text")


def gate_anomalies(spark, sf_dir):
    return gate.anomalies(_tokens(spark, sf_dir))


def scansion_lines(spark, sf_dir):
    verse = table(spark, sf_dir, "loc").join(table(spark, sf_dir, "works").where("unit = 'line'").select(F.col("id").alias("work_id")), "work_id", "left_semi")
    got = scansion.scan(spread(verse.select("loc_id", "text")), "loc_id", "text")
    return got.select("loc_id", "ok", "pattern", "feet", "alternatives", F.array_join("elisions", "; ").alias("elisions"), F.array_join("caesurae", "; ").alias("caesurae"), F.size("syllables").alias("n_syllables"))


def scansion_shapes(spark, sf_dir):
    """Quantity strings read from md5, fitted to the 32 shapes: the metre without the syllables."""
    p = table(spark, sf_dir, "shingle").select("work_id", "tok_offset").distinct().select(F.concat_ws(":", "work_id", "tok_offset").alias("line"))
    text = F.concat(F.md5("line"), F.md5(F.reverse("line")))
    p = p.withColumn("p", F.left(F.translate(text, "0123456789abcdef", "UUUUUUUUULUUUULS"), 12 + F.conv(F.right(F.md5("line"), F.lit(2)), 16, 10).cast("int") % 6))
    return scansion.fitted(p, "line", "p").select("line", "feet", "shape", "alternatives")


def enclitics(spark, sf_dir):
    """Each word of the table, as it is and with each particle attached."""
    w = table(spark, sf_dir, "loc").select(F.explode(words(F.col("text"))).alias("word")).distinct()
    w = w.select(F.explode(F.array("word", *[F.concat("word", F.lit(e)) for e in ("que", "ne", "ve", "cum")])).alias("word")).distinct()
    return w.withColumn("x", forms.split_enclitic(F.col("word"))).select("word", "x.stem", "x.enclitic").where("enclitic IS NOT NULL")


def folds(spark, sf_dir):
    t = spread(table(spark, sf_dir, "loc").where("text IS NOT NULL").select("loc_id", "text"))
    t = t.select("loc_id", "text", forms.fold_display(F.col("text")).alias("d"), forms.fold_index(F.col("text")).alias("x"), forms.strip_quantities(F.col("text")).alias("plain"))
    return t.select("loc_id", F.col("d.text").alias("display"), F.col("x.text").alias("index"), "plain", forms.original_slice(F.col("text"), F.col("x"), F.lit(0), F.size("x.origin")).alias("original"))


def morph_descriptions(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return t.select(forms.describe_morph(F.col("morph"), F.col("pos")).alias("description")).groupBy("description").agg(F.count("*").alias("n"))


def readings_ranked(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    s = e.select("vec_id", F.col("k").cast("string").alias("label"), (F.col("v").cast("double") * 10).alias("score"))
    r = ranked_readings(s, "vec_id", "label", "score")
    return r.select("vec_id", "label", "probability", F.col("rank").cast("bigint").alias("rank"), confidence_label(F.col("probability")).alias("confidence"))


def requests_admitted(spark, sf_dir):
    ok, no = admitted(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return ok.select("doc_id", F.lit("accepted").alias("state")).union(no.select("doc_id", "reason"))


def readings_uncertain(spark, sf_dir):
    return readings.uncertain(readings_ranked(spark, sf_dir).drop("confidence")).select("vec_id", "label", "probability")


def findings_at_token(spark, sf_dir):
    """The findings at every token, of all families."""
    found = constructions(_tokens(spark, sf_dir))
    return readings.findings_by_token(found).select("doc_id", "sent_id", "i", "key", "anchor", "tokens", F.col("rank").cast("bigint").alias("rank"))


def sentence_spans(spark, sf_dir):
    return readings.sentence_spans(_tokens(spark, sf_dir))


def notes_by_line(spark, sf_dir):
    return readings.notes_by_line(retrieval.notes_for(_places(spark, sf_dir), _plain_notes(spark, sf_dir))).withColumn("line", F.col("line").cast("bigint"))


def foot_groups(spark, sf_dir):
    """Syllables of events: users as lines, every seventh without a foot."""
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("user_id").alias("line_id"), F.col("event_id").alias("k"), F.when(F.pmod("event_id", F.lit(7)) > 0, F.floor(F.col("event_id") / 500)).alias("foot"))
    return readings.foot_groups(s).withColumn("n", F.col("n").cast("bigint"))


def dictionary_entries(spark, sf_dir):
    """Entries made of parts: the type's first letters stand for the codes."""
    p = table(spark, sf_dir, "part")
    code = lambda c, n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.col(c), F.lit(len(names))) + 1).cast("int"))  # noqa: E731, ARG005
    e = p.select(F.pmod("p_partkey", F.lit(97)).alias("token"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("headword"), code("p_size", 0, ["N", "ADJ", "V", "ADV"]).alias("pos"), code("p_size", 1, ["1", "2", "3", "4", "5", "9"]).alias("decl"),
                 code("p_partkey", 2, ["M", "F", "N", "X"]).alias("gender"), code("p_partkey", 3, list("ABCDEFIN")).alias("freq"), code("p_size", 4, list("ABCDEFGHX")).alias("age"))
    return readings.lexicon_entries(e, "token", "seq")


def parses_distinct(spark, sf_dir):
    """Parses made of line items, twelve at most of each order and part of the day."""
    li = table(spark, sf_dir, "lineitem")
    p = li.select(F.col("l_suppkey").alias("token"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("lemma"), F.when(F.col("l_linenumber") < 4, "ABL").when(F.col("l_linenumber") < 6, "gen").alias("case"), F.when(F.col("l_linestatus") == "F", "S").otherwise("P").alias("number"), F.lit("N").alias("pos"))
    return readings.distinct_parses(p, "token", "seq")


def analysis_documents(spark, sf_dir):
    """Every admitted document from its text to its result, with stand-in tokens of its lines."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    library = Library(_plain_loc(spark, sf_dir), table(spark, sf_dir, "works"), table(spark, sf_dir, "shingle"), _plain_notes(spark, sf_dir), _known(spark, sf_dir), "codexhall")
    return analyse_texts(docs, "doc_id", "text", lambda lines: annotate(lines, "doc_id", "sent_id", "text"), library)


def analysis_sentences(spark, sf_dir):
    """The sentences of all works with what was found in each, in numbers."""
    s = to_sentences(analyse(_tokens(spark, sf_dir)))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    tagged = F.size(F.filter("tokens", lambda t: t["constructions"] != "")).cast("bigint")
    return s.select("doc_id", "sent_id", n("tokens").alias("n_tokens"), n("findings").alias("n_findings"), tagged.alias("n_tagged"), F.get("findings", F.lit(0))["key"].alias("first_key"))


_SRC, _DST = base_letter_table()


def normal_sql(column: str) -> str:
    """The normalised words of a column as one string, blanks at the ends."""
    t = f"replace(replace(lower(translate({column}, '{_SRC}', '{_DST}')), 'æ', 'ae'), 'œ', 'oe')"
    t = f"regexp_replace(regexp_replace({t}, '\\p{{Mn}}+', '', 'g'), '[^a-z]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\buo(l[ntgpc])', 'uu\\1', 'g')"
    t = f"regexp_replace({t}, '([a-z])uo([ms])\\b', '\\1uu\\2', 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\bquom\\b', 'cum', 'g'), '\\bquoi\\b', 'cui', 'g')"


def words_sql(column: str) -> str:
    return f"list_filter(string_split(coalesce({normal_sql(column)}, ''), ' '), lambda w: w <> '')"


def _plain(column: str) -> str:
    from .queries import PLAIN_REF_SQL

    return PLAIN_REF_SQL.format(ref=column)


def _map(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _description_sql() -> str:
    """The description of a token from its feature columns, written anew for this engine."""
    name = lambda c, f: f"coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in forms.MORPH_NAMES[f].items())}}}[{c}], {c})"
    ws = lambda *x: "concat_ws(' ', " + ", ".join(x) + ")"
    agree = (name("gen", "Gender"), name("cas", "Case"), name("num", "Number"))
    kind = f"coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in forms.POS_NAMES.items())}}}[pos], lower(pos))"
    when = "CASE WHEN coalesce(aspect, '') = 'Perf' OR coalesce(tense, '') = 'Past' THEN 'perfect' WHEN coalesce(aspect, '') = 'Prosp' OR coalesce(tense, '') = 'Fut' THEN 'future' WHEN coalesce(aspect, '') = 'Imp' OR coalesce(tense, '') = 'Pres' THEN 'present' END"
    return f"""CASE vf WHEN 'Gdv' THEN {ws("'gerundive'", *agree)} WHEN 'Ger' THEN {ws("'gerund'", *agree)} WHEN 'Sup' THEN {ws("'supine'", *agree)}
      WHEN 'Part' THEN CASE WHEN concat(aspect, voice) = 'ProspPass' THEN {ws("'gerundive'", *agree)} ELSE {ws(when, name("voice", "Voice"), "'participle'", *agree)} END
      WHEN 'Inf' THEN {ws(name("person", "Person"), name("num", "Number"), name("tense", "Tense"), name("voice", "Voice"), "'infinitive'", kind)}
      ELSE CASE WHEN pos IN ('VERB', 'AUX') THEN {ws(name("person", "Person"), name("num", "Number"), name("tense", "Tense"), name("voice", "Voice"), name("mood", "Mood"), kind)} ELSE {ws(*agree, kind)} END END"""


def oracle_sql() -> dict[str, str]:
    lines = "l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL)"
    fnv = """list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(string_split(array_to_string(list_slice(ws, k, k + 4), ' ') || ' ', ''), lambda c: ascii(c)::UHUGEINT)),
      lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) & 18446744073709551615::UHUGEINT) & 9223372036854775807::UHUGEINT"""
    place = f"p AS (SELECT DISTINCT w.key AS work, {_plain('l.ref')} AS ref, l.leaf AS line FROM loc l JOIN works w ON w.id = l.work_id WHERE l.leaf IS NOT NULL)"
    notes = f"n AS (SELECT id, author, work, language, {_plain('ref')} AS ref, line_start, line_end, lemma, text FROM note)"
    order = "CASE WHEN coalesce(lemma, '') <> '' THEN 0 ELSE 1 END, CASE WHEN language = 'la' THEN 0 ELSE 1 END, line_start ASC NULLS FIRST, id"
    hit = "n.work = p.work AND n.ref = p.ref AND (n.line_start IS NULL OR p.line BETWEEN n.line_start AND coalesce(n.line_end, n.line_start))"
    hits = {k: f"len(list_filter(ws, lambda x: x IN ({', '.join(map(repr, v))})))" for k, v in gate.FUNCTION_WORDS.items()}
    others = [k for k in gate.FUNCTION_WORDS if k != "la"]
    names = ", ".join(map(repr, [*gate.FUNCTION_WORDS]))
    shapes = ", ".join(f"('{r}', '{''.join('LSS' if f == 'D' else 'LL' for f in r)}LX')" for r in ("".join(x) for x in scansion.product("DS", repeat=5)))
    enc = lambda e, ws, ends: f"WHEN word LIKE '%{e}' AND length(word) > {len(e) + 1} AND word NOT IN ({', '.join(map(repr, ws))})" + "".join(f" AND word NOT LIKE '%{x}'" for x in ends)
    cases = [("que", enc("que", forms.QUE_WORDS, ["cumque"])), ("ne", enc("ne", forms.NE_WORDS, forms.NE_ENDINGS)), ("ve", enc("ve", forms.VE_WORDS, []))]
    host = ", ".join(map(repr, forms.CUM_HOSTS))
    hyper = "abs(a.i - a.head) - 1 >= 3"
    del names
    return {
        "text_normalise": f"SELECT loc_id, array_to_string({words_sql('text')}, ' ') AS words FROM loc",
        "text_shingles": f"WITH w AS (SELECT loc_id, {words_sql('text')} AS ws FROM loc) SELECT loc_id, k - 1 AS i, array_to_string(list_slice(ws, k, k + 4), ' ') AS shingle FROM (SELECT loc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM w)",
        "index_offsets": f"WITH {lines}, w AS (SELECT *, len({words_sql('text')}) AS n FROM l0) SELECT doc_id, line_no::BIGINT AS line_no, n::BIGINT AS n_words, (sum(n) OVER (PARTITION BY doc_id ORDER BY line_no) - n)::BIGINT AS tok_offset FROM w",
        "index_shingles": f"""WITH d AS (SELECT doc_id, {words_sql('text')} AS ws FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM d),
          h AS (SELECT doc_id, ({fnv})::BIGINT AS h FROM g) SELECT doc_id, count(*) AS n, count(DISTINCT h) AS n_distinct, min(h) AS least_hash, max(h) AS greatest_hash FROM h GROUP BY doc_id""",
        "passage_identify": f"""WITH d AS (SELECT loc_id, {words_sql('text')} AS ws FROM loc), g AS (SELECT loc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM d),
          q AS (SELECT loc_id, k - 1 AS i, ({fnv})::BIGINT AS h FROM g), x AS (SELECT DISTINCT hash, work_id, tok_offset FROM shingle),
          v AS (SELECT loc_id, work_id, tok_offset - i AS base, count(*) AS votes, min(i) AS first FROM q JOIN x ON x.hash = q.h GROUP BY ALL),
          r AS (SELECT v.*, coalesce(w.source, 'codexhall') AS source FROM v LEFT JOIN works w ON w.id = v.work_id),
          k AS (SELECT *, row_number() OVER (PARTITION BY loc_id ORDER BY votes DESC, (source = 'codexhall') DESC, work_id, first, base) AS rk, count(*) OVER (PARTITION BY loc_id, votes, source) - 1 AS rivals FROM r),
          a AS (SELECT k.*, len(d.ws) AS n, len(d.ws) - 4 AS possible FROM k JOIN d USING (loc_id) WHERE rk = 1 AND CASE WHEN len(d.ws) - 4 < 3 THEN rivals = 0 ELSE votes >= 3 END),
          u AS (SELECT work_id, tok_offset, {_plain('ref')} AS ref, leaf FROM loc),
          m AS (SELECT work_id, tok_offset, max({{'ref': ref, 'leaf': leaf}}) AS x FROM (SELECT work_id, tok_offset, ref, leaf, row_number() OVER (PARTITION BY work_id, tok_offset ORDER BY ref DESC NULLS LAST, leaf DESC NULLS LAST) AS k FROM u) WHERE k = 1 GROUP BY ALL),
          s AS (SELECT a.*, m.x AS s FROM a ASOF JOIN m ON m.work_id = a.work_id AND a.base >= m.tok_offset),
          e AS (SELECT s.*, m.x AS e FROM s ASOF LEFT JOIN m ON m.work_id = s.work_id AND s.base + s.n - 1 >= m.tok_offset)
          SELECT loc_id, w.key AS work, w.author, w.title, w.unit, s.ref AS ref, coalesce(e.ref, s.ref) AS ref_end, s.leaf::BIGINT AS line_start, coalesce(e.leaf, s.leaf)::BIGINT AS line_end,
            least(1.0, CAST(round_even(votes::DOUBLE / possible, 3) AS DOUBLE)) AS confidence, votes AS matched, possible::BIGINT AS possible,
            coalesce(w.author || ', ', '') || w.title || ' ' || CASE WHEN coalesce(s.ref, '') = '' THEN 'line ' || s.leaf ELSE concat_ws('.', s.ref, s.leaf) END || CASE WHEN e.ref IS NOT DISTINCT FROM s.ref AND e.leaf <> s.leaf THEN '-' || e.leaf ELSE '' END AS citation
          FROM e JOIN works w ON w.id = e.work_id""",
        "locate_units": "WITH q AS (SELECT DISTINCT work_id, tok_offset AS t FROM shingle), u AS (SELECT DISTINCT work_id, tok_offset FROM loc) SELECT q.work_id || ':' || q.t AS q, u.tok_offset FROM q ASOF JOIN u ON u.work_id = q.work_id AND q.t >= u.tok_offset",
        "canonical_lines": f"""WITH r AS (SELECT id, work, {_plain('ref')} AS ref, least(line_start, coalesce(line_end, line_start)) AS a, greatest(line_start, coalesce(line_end, line_start)) AS b FROM note WHERE line_start IS NOT NULL),
          l AS (SELECT w.key AS work, {_plain('l.ref')} AS ref, l.leaf, l.text FROM loc l JOIN works w ON w.id = l.work_id)
          SELECT r.id AS request, count(*) AS n, min(leaf) AS first, max(leaf) AS last, count(text) AS with_text FROM r JOIN l ON l.work = r.work AND l.ref = r.ref AND l.leaf BETWEEN a AND b GROUP BY r.id""",
        "notes_for": f"""WITH {place}, {notes}, h AS (SELECT p.work || '|' || p.ref AS request, p.line, n.*, row_number() OVER (PARTITION BY p.work, p.ref, p.line ORDER BY {order}) AS rank FROM p JOIN n ON {hit})
          SELECT request, line::BIGINT AS line, rank, id FROM h WHERE rank <= 12""",
        "commentary_for": f"""WITH {place}, f AS (SELECT work, ref, min(line) AS lo FROM p GROUP BY ALL), hi AS (SELECT work, ref, max(line) AS hi FROM p GROUP BY ALL),
          p2 AS (SELECT work, ref, unnest(range(lo, least(hi, lo + 24) + 1)) AS line FROM f JOIN hi USING (work, ref)), {notes},
          h AS (SELECT p.work || '|' || p.ref AS request, p.line, n.id, n.author, n.lemma, n.text, row_number() OVER (PARTITION BY p.work, p.ref, p.line ORDER BY {order}) AS rank FROM p2 p JOIN n ON {hit}),
          o AS (SELECT *, row_number() OVER (PARTITION BY request, author, lemma, left(text, 60) ORDER BY line, rank, id) AS k FROM h WHERE rank <= 8)
          SELECT request, line::BIGINT AS line, id FROM o WHERE k = 1""",
        "coverage": f"""WITH {place}, {notes}, t AS (SELECT work, ref, max(line)::BIGINT AS n_required, count(*) AS n_present FROM p GROUP BY ALL),
          c AS (SELECT p.work, p.ref, count(DISTINCT p.line) AS n_noted FROM p JOIN n ON n.work = p.work AND n.ref = p.ref AND p.line BETWEEN n.line_start AND coalesce(n.line_end, n.line_start) GROUP BY ALL)
          SELECT work, ref, n_required, n_present, coalesce(n_noted, 0) AS n_noted, CAST(round_even(100.0::DOUBLE * n_present / n_required, 1) AS DOUBLE) AS present, CAST(round_even(100.0::DOUBLE * coalesce(n_noted, 0) / n_required, 1) AS DOUBLE) AS noted, n_required - n_present AS gaps
          FROM t LEFT JOIN c USING (work, ref)""",
        "gate_assess": f"""WITH v AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM loc), d AS (SELECT doc_id, {words_sql('text')} AS ws FROM documents),
          k AS (SELECT doc_id, count(*) AS n, count(v.word) AS known FROM (SELECT doc_id, unnest(ws) AS word FROM d) e LEFT JOIN v USING (word) GROUP BY doc_id),
          s AS (SELECT doc_id, len(ws) AS n, {', '.join(f'{h} AS {c}' for c, h in hits.items())} FROM d),
          t AS (SELECT *, {' + '.join(hits)} AS total, greatest({', '.join(others)}) AS top, CASE {' '.join(f"WHEN {o} = greatest({', '.join(others)}) THEN '{o}'" for o in sorted(others))} END AS lang FROM s),
          a AS (SELECT t.doc_id, t.n, CASE WHEN t.n = 0 THEN NULL ELSE k.known::DOUBLE / t.n END AS rate, CASE WHEN t.n >= 5 THEN CASE WHEN total = 0 THEN 0.0 ELSE la::DOUBLE / total END END AS latin,
            CASE WHEN t.n >= 5 AND total > 0 AND top::DOUBLE / total > 0.3 THEN lang END AS competitor FROM t LEFT JOIN k USING (doc_id)),
          b AS (SELECT *, (n >= 5 AND coalesce(latin, 0) < 0.15 AND competitor IS NOT NULL) AS alien FROM a),
          c AS (SELECT *, coalesce(rate >= 0.75, false) AND NOT alien AS yes FROM b)
          SELECT doc_id, yes AS is_latin, CAST(round_even(CASE WHEN n = 0 THEN 0.0 WHEN yes THEN rate ELSE 1 - rate END, 3) AS DOUBLE) AS confidence, CAST(round_even(coalesce(rate, 0.0), 3) AS DOUBLE) AS analysable_rate,
            CAST(round_even(latin, 3) AS DOUBLE) AS latin, competitor, CASE WHEN n = 0 THEN 'no words' WHEN NOT yes AND alien THEN 'another language' WHEN NOT yes AND rate < 0.2 THEN 'hardly a word is known' WHEN NOT yes THEN 'too few words are known' WHEN rate < 0.85 THEN 'some words are unknown' ELSE '' END AS message FROM c""",
        "gate_unrecognised": f"""WITH v AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM loc), d AS (SELECT doc_id, {words_sql('text')} AS ws FROM documents),
          e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS position FROM d) SELECT doc_id, count(*) AS n, min(position) AS first, max(word) AS greatest FROM e WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.word = e.word) GROUP BY doc_id""",
        "gate_anomalies": f"""WITH {annotation_sql()}, tok AS MATERIALIZED (SELECT * FROM flat0),
          hb AS (SELECT doc_id, sent_id, unnest([a.i, a.head]) AS i FROM tok a WHERE a.pos IN ('ADJ', 'DET', 'NUM') AND a.dep IN ('amod', 'det', 'nummod') AND {hyper}),
          wr AS (SELECT a.doc_id, a.sent_id, a.i, CASE WHEN a.cas <> h.cas THEN 'Case' WHEN a.num <> h.num THEN 'Number' WHEN a.gen <> h.gen THEN 'Gender' END AS feature
            FROM tok a JOIN tok h ON h.doc_id = a.doc_id AND h.sent_id = a.sent_id AND h.i = a.head WHERE a.pos IN ('ADJ', 'DET', 'NUM') AND a.dep IN ('amod', 'det', 'nummod'))
          SELECT {KEY}, i, 'agreement' AS kind, feature FROM wr WHERE feature IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hb WHERE hb.doc_id = wr.doc_id AND hb.sent_id = wr.sent_id AND hb.i = wr.i)
          UNION ALL SELECT doc_id, min(sent_id), 0, 'no_finite_verb', '' FROM tok GROUP BY doc_id HAVING count(*) FILTER (WHERE vf = 'Fin') = 0""",
        "scansion_shapes": f"""WITH s AS (SELECT * FROM (VALUES {shapes}) t(feet, shape)), l AS (SELECT DISTINCT work_id || ':' || tok_offset AS line FROM shingle),
          p AS (SELECT line, left(translate(md5(line) || md5(reverse(line)), '0123456789abcdef', 'UUUUUUUUULUUUULS'), (12 + ('0x' || right(md5(line), 2))::INT % 6)::INT) AS p FROM l),
          h AS (SELECT line, feet, shape, row_number() OVER (PARTITION BY line ORDER BY (right(feet, 1) = 'S'), feet) AS k, count(*) OVER (PARTITION BY line) - 1 AS alternatives
            FROM p JOIN s ON length(s.shape) = length(p.p) AND regexp_full_match(s.shape, replace(left(p, length(p) - 1), 'U', '.') || 'X'))
          SELECT line, feet, shape, alternatives FROM h WHERE k = 1""",
        "enclitics": f"""WITH v AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM loc), w AS (SELECT DISTINCT word || e AS word FROM v, (VALUES (''), ('que'), ('ne'), ('ve'), ('cum')) t(e)),
          e AS (SELECT word, CASE WHEN word IN ({host}) THEN 'cum' {' '.join(f"{c} THEN '{e}'" for e, c in cases)} END AS enclitic FROM w)
          SELECT word, left(word, length(word) - length(enclitic)) AS stem, enclitic FROM e WHERE enclitic IS NOT NULL""",
        "readings_ranked": """WITH e AS (SELECT vec_id, (unnest(range(len(embedding))))::VARCHAR AS label, unnest(embedding)::DOUBLE * 10 AS s FROM embeddings),
          x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM e), p AS (SELECT vec_id, label, CAST(round_even(e / sum(e) OVER (PARTITION BY vec_id), 4) AS DOUBLE) AS probability, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, label) AS rank FROM x)
          SELECT vec_id, label, probability, rank, CASE WHEN probability >= 0.85 THEN 'high' WHEN probability >= 0.7 THEN 'moderate' ELSE 'tentative' END AS confidence FROM p WHERE rank <= 5 AND probability >= 0.01""",
        "morph_descriptions": f"WITH {annotation_sql()} SELECT description, count(*) AS n FROM (SELECT {_description_sql()} AS description FROM flat0) GROUP BY description",
        "readings_uncertain": """WITH e AS (SELECT vec_id, (unnest(range(len(embedding))))::VARCHAR AS label, unnest(embedding)::DOUBLE * 10 AS s FROM embeddings),
          x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM e), p AS (SELECT vec_id, label, CAST(round_even(e / sum(e) OVER (PARTITION BY vec_id), 4) AS DOUBLE) AS probability, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, label) AS rank FROM x)
          SELECT vec_id, label, probability FROM p WHERE rank = 1 AND probability < 0.9 AND probability >= 0.01""",
        "findings_at_token": all_sql() + f"""SELECT doc_id, sent_id, i::INT AS i, key, anchor, tokens, row_number() OVER (PARTITION BY doc_id, sent_id, i ORDER BY confidence DESC, key, anchor, tokens) AS rank
          FROM (SELECT *, unnest(list_distinct(string_split(tokens, ','))) AS i FROM {KEPT})""",
        "analysis_sentences": all_sql() + f""", k AS (SELECT * FROM {KEPT}), n AS (SELECT doc_id, sent_id, count(*) AS n_findings, arg_min(key, (-confidence, key, anchor, tokens)) AS first_key FROM k GROUP BY ALL),
          g AS (SELECT doc_id, sent_id, count(DISTINCT i) AS n_tagged FROM (SELECT doc_id, sent_id, unnest(string_split(tokens, ',')) AS i FROM k) GROUP BY ALL),
          t AS (SELECT doc_id, sent_id, count(*) AS n_tokens FROM tok GROUP BY ALL)
          SELECT doc_id, sent_id, n_tokens, coalesce(n_findings, 0) AS n_findings, coalesce(n_tagged, 0) AS n_tagged, first_key FROM t LEFT JOIN n USING (doc_id, sent_id) LEFT JOIN g USING (doc_id, sent_id)""",
        "sentence_spans": f"WITH {annotation_sql()} SELECT doc_id, sent_id, min(i) AS first, max(i) AS last, count(*) AS n_tokens FROM flat0 GROUP BY doc_id, sent_id",
        "notes_by_line": f"""WITH {place}, {notes}, h AS (SELECT p.work || '|' || p.ref AS request, p.line, n.*, row_number() OVER (PARTITION BY p.work, p.ref, p.line ORDER BY {order}) AS rank FROM p JOIN n ON {hit})
          SELECT request, line::BIGINT AS line, string_agg(id, ',' ORDER BY rank) AS notes FROM h WHERE rank <= 12 GROUP BY request, line""",
        "foot_groups": """WITH s AS (SELECT user_id AS line_id, event_id AS k, CASE WHEN event_id % 7 > 0 THEN event_id // 500 END AS foot FROM events),
          c AS (SELECT *, last_value(foot IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS f FROM s),
          g AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY k) - row_number() OVER (PARTITION BY line_id, f ORDER BY k) AS grp FROM c),
          m AS (SELECT line_id, f, grp, min(k) AS k0, string_agg(k, ',' ORDER BY k) AS members FROM g GROUP BY ALL)
          SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY k0) AS n, f AS foot, members FROM m""",
        "dictionary_entries": f"""WITH e AS (SELECT p_partkey % 97 AS token, p_partkey AS seq, p_name AS headword, (['N', 'ADJ', 'V', 'ADV'])[p_size % 4 + 1] AS pos, (['1', '2', '3', '4', '5', '9'])[p_size % 6 + 1] AS decl, (['M', 'F', 'N', 'X'])[p_partkey % 4 + 1] AS gender,
            ('ABCDEFIN')[p_partkey % 8 + 1] AS freq, ('ABCDEFGHX')[p_size % 9 + 1] AS age FROM part),
          k AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY seq, headword) AS k FROM e)
          SELECT token, seq, headword, pos, CASE WHEN pos IN ('N', 'ADJ') THEN {_map('decl', readings.DECLENSION)} WHEN pos = 'V' THEN {_map('decl', readings.CONJUGATION)} END AS declension, {_map('gender', readings.GENDER)} AS gender,
            {_map('freq', readings.FREQUENCY)} AS frequency, {_map('age', readings.AGE)} AS age FROM k WHERE k <= 4""",
        "parses_distinct": """WITH p AS (SELECT l_suppkey AS token, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS lemma, CASE WHEN l_linenumber < 4 THEN 'ABL' WHEN l_linenumber < 6 THEN 'gen' END AS c, CASE WHEN l_linestatus = 'F' THEN 'S' ELSE 'P' END AS number FROM lineitem),
          k AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY seq, lemma) AS k FROM p),
          d AS (SELECT *, row_number() OVER (PARTITION BY token, lemma, c, number ORDER BY k) AS d FROM k WHERE k <= 12)
          SELECT token, seq, lemma, 'N' AS pos, CASE c WHEN 'ABL' THEN 'ablative' WHEN 'gen' THEN 'genitive' END AS "case", CASE number WHEN 'S' THEN 'singular' ELSE 'plural' END AS number FROM d WHERE d = 1""",
        "requests_admitted": r"SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\s\p{Z}]') THEN 'blank' WHEN length(text) > 20000 THEN 'too long' ELSE 'accepted' END AS state FROM documents",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (
        text_normalise, text_shingles, index_offsets, index_shingles, passage_identify, locate_units, canonical_lines, notes_for, commentary_for, coverage, gate_assess, gate_unrecognised,
        gate_anomalies, scansion_lines, scansion_shapes, enclitics, folds, morph_descriptions, readings_ranked, requests_admitted, analysis_documents, analysis_sentences, readings_uncertain, findings_at_token, sentence_spans,
        notes_by_line, foot_groups, dictionary_entries, parses_distinct,
    )
    return {f.__name__: f for f in all_of}
