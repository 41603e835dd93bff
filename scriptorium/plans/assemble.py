"""The whole analysis: texts in, tables out, and one nested document per text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_blanks
from ..operators import gate, retrieval, whole_texts
from ..operators.constructions import DETECTORS, constructions, token_tags
from ..operators.figures import anaphora, figures
from ..operators.gate import anomalies
from ..operators.scansion import scan
from ..operators.token_context import features
from ..session import map_batches, materialise

#: Longest text that a request may hold.
MOST_CHARACTERS = 20_000


def admitted(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, refused rows with ``reason``): blank, null and overlong texts are refused."""
    reason = F.when(F.coalesce(strip_blanks(F.col(text)), F.lit("")) == "", "blank").when(F.length(text) > MOST_CHARACTERS, "too long")
    marked = texts.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


@dataclass(frozen=True)
class Analysis:
    """The tables of an analysis; each is lazy and computed when used."""

    tokens: DataFrame
    findings: DataFrame
    figures: DataFrame
    anomalies: DataFrame
    scansion: DataFrame | None


def analyse(tokens: DataFrame, lines: DataFrame | None = None, quantities: DataFrame | None = None) -> Analysis:
    """Constructions, figures, anomalies and, where ``lines(line_id, text)`` are given, scansion.

    The branches share the token table only; each takes the keys it needs.
    """
    return Analysis(
        tokens=tokens,
        findings=constructions(tokens),
        figures=figures(tokens).unionByName(anaphora(tokens)),
        anomalies=anomalies(tokens),
        scansion=None if lines is None else scan(lines, "line_id", "text", quantities),
    )


def _listed(df: DataFrame, name: str) -> DataFrame:
    """Findings of a sentence as one list, by falling confidence, then key and anchor."""
    row = F.struct((-F.col("confidence")).alias("order"), *[c for c in ("key", "anchor", "tokens", "confidence", "label") if c in df.columns])
    return df.groupBy("doc_id", "sent_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x.dropFields("order")).alias(name))


def to_sentences(analysis: Analysis) -> DataFrame:
    """``(doc_id, sent_id, tokens, findings, figures)``: each sentence with its tokens in order, their
    tags, and what was found in it."""
    findings = materialise(analysis.findings)  # listed, and turned into tags
    flat = analysis.tokens.withColumn("morph", F.to_json("morph"))
    tok = flat.join(token_tags(findings), ["doc_id", "sent_id", "i"], "left").groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("i", "text", "lemma", "pos", "dep", "head", "morph", F.coalesce("keys", F.lit("")).alias("constructions")))).alias("tokens"))
    return tok.join(_listed(findings, "findings"), ["doc_id", "sent_id"], "left").join(_listed(analysis.figures, "figures"), ["doc_id", "sent_id"], "left")


def to_documents(analysis: Analysis) -> DataFrame:
    """``(doc_id, analysis)``: per document its sentences as JSON, in order.

    A document comes as one string, so it must be a text as requests hold them (:func:`admitted`);
    of whole works take :func:`to_sentences`.
    """
    per = to_sentences(analysis).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "tokens", "findings", "figures"))).alias("sentences"))
    return per.select("doc_id", F.to_json(F.struct("sentences")).alias("analysis"))


def _joined_documents(tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts(doc_id, ...)`` plus ``sentences`` and ``anomalies`` of each document, null where there are none."""
    a = analyse(tokens)
    odd = a.anomalies.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "i", "kind", "feature"))).alias("anomalies"))
    sentences = to_sentences(a).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "tokens", "findings", "figures"))).alias("sentences"))
    return parts.join(odd, "doc_id", "left").join(sentences, "doc_id", "left")


def _documents(tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of :func:`_joined_documents` for bounded documents, without the detectors that users add.

    If both inputs come partitioned by ``doc_id`` in the same way, neither tokens nor findings are
    written or shuffled: the rows of a document lie together and are taken through all rules at once
    (:mod:`~scriptorium.operators.whole_texts`). The row of ``parts`` goes along with them.
    """
    flat = features(tokens.withColumn("raw", F.to_json("morph")), "lemma", "raw").withColumnRenamed("raw", "morph")
    row = ["doc_id", "sent_id", *whole_texts.RAW, *[c for c in whole_texts.ORDER if c not in whole_texts.RAW]]
    kinds = {f.name: f.dataType for f in flat.schema.fields}
    p = parts.select("doc_id", *[F.lit(None).cast(kinds[c]).alias(c) for c in row[1:]], F.struct(*[c for c in parts.columns if c != "doc_id"]).alias("part"))
    both = flat.select(*row, F.lit(None).cast(p.schema["part"].dataType).alias("part")).unionByName(p)
    # the window asks for the rows of a document together and in order, and shuffles only if they are not
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id", *whole_texts.RAW)))
    docs = map_batches(both, whole_texts.texts, f"doc_id {kinds['doc_id'].simpleString()}, part {p.schema['part'].dataType.simpleString()}, {whole_texts.PER_TEXT}").select("doc_id", "part.*", "sentences", "anomalies")
    return docs.withColumns({c: F.when(F.col("doc_id").isNotNull(), F.col(c)) for c in ("sentences", "anomalies")})


@dataclass(frozen=True)
class Library:
    """What texts are held against: the tables of the index, the commentary, and known words."""

    loc: DataFrame
    works: DataFrame
    shingle: DataFrame
    note: DataFrame
    known: DataFrame
    main_source: str = "editions"


def analyse_texts(texts: DataFrame, key: str, text: str, annotator: Callable[[DataFrame], DataFrame], library: Library, quantities: DataFrame | None = None) -> DataFrame:
    """From plain texts to results: ``(doc_id, is_latin, citation, is_verse, n_notes, analysis)``.

    Only admitted texts have a row, so each is bounded. ``annotator`` turns ``lines(doc_id, sent_id,
    text)`` into tokens. The JSON holds the gate's judgement, the citation, the notes on the cited
    lines, the scansion of each line, and the sentences with tokens, constructions and figures; what
    is irregular stands under ``anomalies``. Texts that are not Latin are analysed all the same. A
    text without tokens, or that no work holds, has null in those parts.
    """
    # a text is shuffled once; from there to its result it stays in its task
    tasks = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ok = admitted(texts.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")[0].repartition(tasks, "doc_id")
    lines = ok.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("sent_id", "text")).withColumn("sent_id", F.col("sent_id").cast("bigint"))
    rate = gate.analysable(ok, "doc_id", "text", library.known)
    judged = gate.assess(rate, gate.language_scores(ok, "doc_id", "text"), "doc_id")
    cited = materialise(retrieval.identify(ok, "doc_id", "text", library.shingle, library.loc, library.works, library.main_source))
    spans = cited.select(F.col("doc_id").alias("request"), "work", "ref", F.col("line_start").alias("first"), F.when(F.col("ref").eqNullSafe(F.col("ref_end")), F.col("line_end")).otherwise(F.col("line_start")).alias("last"))
    notes = retrieval.commentary_for(spans, library.note).groupBy(F.col("request").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("line", "rank", "author", "lemma", F.col("text").alias("note")))).alias("notes"))
    keyed = lines.where(strip_blanks(F.col("text")) != "").select(F.struct("doc_id", "sent_id").alias("k"), "text")
    scans = scan(keyed, "k", "text", quantities, whole=False).select("k.doc_id", "k.sent_id", "ok", "pattern", "caesurae")
    n, fit = F.count("*"), F.count_if("ok")
    verse = scans.groupBy("doc_id").agg(((fit >= 1) & ((n <= 2) | (fit * 2 >= n))).alias("is_verse"), F.array_sort(F.collect_list(F.struct("sent_id", "ok", "pattern", "caesurae"))).alias("scansion"))
    full = ok.select("doc_id").join(judged, "doc_id", "left").join(cited.select("doc_id", "citation"), "doc_id", "left")
    for part in (notes, verse):
        full = full.join(part, "doc_id", "left")
    # what belongs to the whole text goes as one string along with its tokens
    small = full.select(
        "doc_id", "is_latin", "citation", F.coalesce("is_verse", F.lit(False)).alias("is_verse"), F.coalesce(F.size("notes"), F.lit(0)).cast("bigint").alias("n_notes"),
        F.to_json(F.struct(F.struct("is_latin", "confidence", "message").alias("gate"), "citation", "notes", "scansion")).alias("begin"),
    )
    if DETECTORS:  # they take tokens as a table
        full = _joined_documents(materialise(annotator(lines)), small)
    else:
        full = _documents(annotator(lines), small.repartition(tasks, "doc_id"))
    # two objects as one: the first always has the gate
    both = F.concat(F.substring("begin", F.lit(1), F.length("begin") - 1), F.lit(","), F.ltrim(F.to_json(F.struct("anomalies", "sentences")), F.lit("{")))
    whole = F.when(F.col("anomalies").isNull() & F.col("sentences").isNull(), F.col("begin")).otherwise(both)
    return full.select("doc_id", "is_latin", "citation", "is_verse", "n_notes", whole.alias("analysis"))


def ranked_readings(scores: DataFrame, token: str, label: str, score: str, most: int = 5, least: float = 0.01) -> DataFrame:
    """Softmax of an annotator's scores over the labels of a token: the ``most`` likeliest with a
    probability of ``least`` or more, ``(token, label, probability, rank)``. Null scores are left out."""
    from pyspark.sql import Window

    by = Window.partitionBy(token)
    s = scores.where(F.col(score).isNotNull()).withColumn("e", F.exp(F.col(score) - F.max(score).over(by)))
    s = s.withColumn("probability", F.bround(F.col("e") / F.sum("e").over(by), 4)).withColumn("rank", F.row_number().over(by.orderBy(F.col("e").desc(), label)))
    return s.where((F.col("rank") <= most) & (F.col("probability") >= least)).select(token, label, "probability", "rank")


def confidence_label(confidence):
    """high from 0.85, moderate from 0.7, else tentative."""
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.7, "moderate").otherwise("tentative")
