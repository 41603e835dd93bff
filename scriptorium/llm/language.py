"""Languages of texts and of their segments, by string kernels.

Method: blended-spectrum presence kernels (character n-grams of 2 to 4, word ends included): the
kernel of two sentences is the number of different n-grams they share over the root of the product
of their numbers. Nyström landmarks span the feature space, one-versus-rest ridge regression is
solved in it on a bounded sample of labelled notes, and since the kernel is linear in the presence
vector the landmarks fold into one weight row per n-gram: a batch of sentences is scored by one
product of its sparse presence matrix with that weight matrix.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import map_batches
from .visual import plain_text

LANGUAGES = ("la", "en", "de", "fr", "it", "grc")
#: Bound of the training sample: notes per language, sentences per language among them (the first in
#: the order of the sample), and landmarks per language among these (likewise the first).
TRAINING_NOTES = 150
TRAINING_SENTENCES = 1000
LANDMARKS = 40
RIDGE = 0.05
#: n-grams are hashed to this many buckets; text and bucket share one 32-bit number.
BUCKET_BITS = 18
MOST_ROWS = 1 << (32 - BUCKET_BITS)
#: A sentence whose best score leads by less takes the language of its text.
LEAST_LEAD = 0.15

# Usual names and codes of the languages, and labels that say nothing.
NAMES = {
    "la": "la lat latin latina latine",
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french francais français",
    "it": "it ita italian italiano",
    "grc": "grc el ell gre greek graece ancientgreek",
}
SAYS_NOTHING = ("", "-", "--", "?", "unknown", "und", "none", "null", "n/a", "na", "xx", "zxx", "mis", "mul")


def label_language(label: Column) -> Column:
    """The language that a label names: its code, null if it says nothing, ``other`` if it names
    none of the six. Case, outer blanks and a region after a hyphen do not matter."""
    plain = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    bare = F.regexp_replace(plain, r"^([a-z]{2,3})[-_].*$|[\s\p{Z}]+", "$1")
    out = F.when(label.isNull() | plain.isin(*SAYS_NOTHING), F.lit(None))
    for code, names in NAMES.items():
        out = out.when(bare.isin(*names.split()), code)
    return out.otherwise("other")


_QUOTED = re.compile(r"(?<!\w)'[^'\n]+'(?!\w)|\"[^\"\n]+\"|[«“][^»”\n]+[»”]")
_QUOTES, _BRACKETS = "'\"«“", "(["
_ASIDE = re.compile(r"\([^()\n]*\)|\[[^\[\]\n]*\]")
_HEAD = re.compile(r"^[^.:!?]*:\s+")
_REFERENCE = re.compile(r"\b[A-Z]{2,}\.?\s*\d+|\d+(?:[.,]\d+)*")
_SENTENCE = re.compile(r"(?<=[.!?;·])[\"')\]]*\s+|\n+")
_SEE = re.compile(r"\b(?:[Cc]fr?|[Vv]gl|[Cc]onf)\.\s+[^.!?\n]*[.!?]?")
_WORD = re.compile(r"[^\W\d_]{2,}")
_DIGIT = re.compile(r"\d")


def sentences(text: str | None) -> list[str]:
    """The whole sentences of a text, without its headword (what stands before the first colon),
    quoted words, asides and references. A sentence has a word of two letters or more; short ones
    rarely lead by much and then go with their text."""
    if not text:
        return []
    # each pattern is asked only where the text holds a sign that it needs
    text = unicodedata.normalize("NFC", text)
    text = _HEAD.sub("", text, count=1) if ":" in text else text
    if any(c in text for c in _QUOTES):
        text = _QUOTED.sub(" ", text)
    if any(c in text for c in _BRACKETS):
        text = _ASIDE.sub(" ", text)
    if "f." in text or "fr." in text or "gl." in text:
        text = _SEE.sub(" ", text)
    out = []
    for part in _SENTENCE.split(text):
        s = " ".join((_REFERENCE.sub(" ", part) if _DIGIT.search(part) else part).split())
        if _WORD.search(s):
            out.append(s)
    return out


@functools.cache
def _letters() -> np.ndarray:
    """For each character of the first plane its small letter, 32 for what is no letter."""
    return np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in map(chr, range(1 << 16))], np.uint32)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, buckets, sizes): the presence matrix of the n-grams of a batch, in coordinates sorted
    by row, and how many different ones each text has."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(texts) > MOST_ROWS:
        parts = [presence(texts[k : k + MOST_ROWS]) for k in range(0, len(texts), MOST_ROWS)]
        rows = [r + k * MOST_ROWS for k, (r, _, _) in enumerate(parts)]
        return np.concatenate(rows), np.concatenate([c for _, c, _ in parts]), np.concatenate([n for _, _, n in parts])
    joined = "\0".join(texts)
    if joined.count("\0") != len(texts) - 1:
        joined = "\0".join(t.replace("\0", " ") for t in texts)
    codes = np.frombuffer(f"\0{joined}\0".encode("utf-32-le", "replace"), np.uint32)
    # every text stands between two zeros, which count as blanks; of a run of blanks one is kept
    plain = np.where(codes < 1 << 16, _letters()[codes & 0xFFFF], codes)
    plain = np.where(codes == 0, np.uint32(0), plain)
    plain = plain[(plain != 32) | (np.roll(plain, 1) > 32)]
    plain = plain[(plain != 32) | (np.roll(plain, -1) != 0)]
    edges = np.flatnonzero(plain == 0)
    row = np.cumsum(plain == 0).astype(np.uint32) - np.uint32(1)
    h, keys = plain, []
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(0x9E3779B1) + plain[n - 1 :]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        key = (row[: len(h)] << np.uint32(BUCKET_BITS)) | (mixed >> np.uint32(32 - BUCKET_BITS))
        for back in range(1, n - 1):  # what runs over the end of a text counts as its first n-gram
            at = edges - back
            at = at[(at >= 0) & (at < len(key))]
            key[at] = keys[0][edges[row[at]]] if keys else key[at]
        keys.append(key)
    key = np.sort(np.concatenate(keys))  # sorting and comparing neighbours is faster here than np.unique
    key = key[np.flatnonzero(np.diff(key, prepend=~key[:1]))]
    rows = (key >> np.uint32(BUCKET_BITS)).astype(np.int64)
    return rows, (key & np.uint32((1 << BUCKET_BITS) - 1)).astype(np.int64), np.bincount(rows, minlength=len(texts))


@dataclass(frozen=True)
class KernelClassifier:
    """One row of weights for each n-gram bucket, one column for each language it knows."""

    weights: np.ndarray
    languages: tuple[str, ...]

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row of one-versus-rest scores for each text: the sum of its buckets' weights."""
        rows, cols, sizes = presence(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(rows):
            begin = np.flatnonzero(np.diff(rows, prepend=-1))
            out[rows[begin]] = np.add.reduceat(self.weights.take(cols, axis=0), begin, axis=0)
        return out / np.sqrt(np.maximum(sizes, 1))[:, None]


def _dense(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows, cols, sizes = presence(texts)
    used, at = np.unique(cols, return_inverse=True)
    m = np.zeros((len(texts), len(used)), np.float32)
    m[rows, at] = 1
    return m / np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32), used


def fit(texts: list[str], labels: list[str]) -> KernelClassifier:
    """Kernel ridge regression on Nyström landmarks; fitted twice, the second time without the
    sentences that the first fit gives to another language than their label (wrong labels, and
    sentences in another language than their note)."""
    names = tuple(x for x in LANGUAGES if x in set(labels))
    if not names:
        return KernelClassifier(np.zeros((1 << BUCKET_BITS, 0), np.float32), ())
    y = np.array([names.index(x) for x in labels])
    phi, used = _dense(texts)  # linear kernel on normalised presence: K = phi phi^T
    keep = np.ones(len(y), bool)
    for _ in range(2):
        marks = np.concatenate([np.flatnonzero(keep & (y == k))[:LANDMARKS] for k in range(len(names))])
        rows = np.flatnonzero(keep)
        k_mm = (phi[marks] @ phi[marks].T).astype(np.float64)
        k_nm = (phi[rows] @ phi[marks].T).astype(np.float64)
        value, vector = np.linalg.eigh(k_mm)
        good = value > 1e-8 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        z = k_nm @ root
        target = np.where(y[rows][:, None] == np.arange(len(names)), 1.0, -1.0)
        weight = (1 / np.bincount(y[rows], minlength=len(names)).clip(1))[y[rows]] * len(rows) / len(names)  # classes count alike
        w = np.linalg.solve(z.T @ (z * weight[:, None]) + RIDGE * np.eye(z.shape[1]) * len(rows) / 100, z.T @ (target * weight[:, None]))
        folded = phi[marks].T.astype(np.float64) @ (root @ w)
        keep = (phi @ folded).argmax(1) == y
        if not all((keep & (y == k)).any() for k in range(len(names))):
            break
    weights = np.zeros((1 << BUCKET_BITS, len(names)), np.float32)
    weights[used] = folded
    return KernelClassifier(weights, names)


def training_sample(notes: DataFrame) -> list[tuple[str, str]]:
    """At most TRAINING_NOTES (language, text) per language, those of the least id hashes; the
    top-n is cut in each task before the shuffle, so the driver gets a bounded number of rows."""
    rows = notes.select("id", label_language(F.col("language")).alias("lang"), F.col("text")).where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    best = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    rows = rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= TRAINING_NOTES)
    return [(r.lang, r.text) for r in rows.select("lang", plain_text(F.col("text")).alias("text")).orderBy("lang", F.xxhash64("text")).collect()]


def trained(notes: DataFrame) -> KernelClassifier:
    """The classifier of the labelled notes of this table."""
    texts, labels = [], []
    for lang, text in training_sample(notes):
        for s in sentences(text)[: max(0, TRAINING_SENTENCES - labels.count(lang))]:
            texts.append(s)
            labels.append(lang)
    return fit(texts, labels)


def segments(notes: DataFrame, model: KernelClassifier | None = None) -> DataFrame:
    """``(note_id, label, segment, language, confidence, sentences)``.

    A segment is a stretch of consecutive whole sentences in one language, numbered from 1. A text
    without a whole sentence is one segment, judged as it is; null, empty and letterless texts have
    none. A sentence whose best language leads by little goes with its text. ``confidence`` is the
    softmax of the scores, averaged over the sentences. Repeated rows each come out.
    """
    import pyarrow as pa

    spark = notes.sparkSession
    shared = spark.sparkContext.broadcast(model or trained(notes))  # 2^BUCKET_BITS rows of six numbers
    source = notes.select(F.col("id").alias("note_id"), label_language(F.col("language")).alias("label"), plain_text(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clf: KernelClassifier = shared.value
        names = ["note_id", "label", "segment", "language", "confidence", "sentences"]
        for batch in batches:
            parts, owner = [], []
            for k, t in enumerate(batch.column(2).to_pylist()):
                found = sentences(t) or ([t] if t and _WORD.search(t) else [])
                parts += found
                owner += [k] * len(found)
            if not parts or not clf.languages:
                continue
            owner = np.array(owner)
            score = clf.scores(parts)
            p = np.exp(3 * (score - score.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            two = np.sort(score, axis=1)
            sure = two[:, -1] - (two[:, -2] if two.shape[1] > 1 else -1) >= LEAST_LEAD
            # what the sure sentences of a note say together, or all of them if none is sure
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            note = np.cumsum(np.diff(owner, prepend=-1) > 0) - 1
            counts = sure | ~np.logical_or.reduceat(sure, first)[note]
            main = np.add.reduceat(p * counts[:, None], first, axis=0).argmax(1)
            lang = np.where(sure, score.argmax(1), main[note])
            conf = p[np.arange(len(lang)), lang]
            starts = np.flatnonzero((np.diff(owner, prepend=-1) > 0) | (np.diff(lang, prepend=-1) != 0))
            size = np.diff(starts, append=len(lang))
            opens = np.flatnonzero(np.diff(note[starts], prepend=-1))
            nth = np.arange(len(starts)) - opens[note[starts]] + 1
            rows = pa.array(owner[starts])
            names_of = np.array(clf.languages, dtype=object)[lang[starts]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(nth.astype(np.int32)), pa.array(names_of, pa.string()), pa.array(np.add.reduceat(conf, starts) / size), pa.array(size.astype(np.int32))], names=names
            )

    return map_batches(source, run, "note_id bigint, label string, segment int, language string, confidence double, sentences int")


def mislabelled(notes: DataFrame, model: KernelClassifier | None = None) -> DataFrame:
    """``(note_id, language)``: every language of each note whose label is missing, says nothing or
    names another language, or whose text has whole sentences in more than one. Notes without text
    give nothing. Notes of the same id count as one."""
    seg = segments(notes, model)
    per = seg.groupBy("note_id").agg(F.collect_set("language").alias("languages"), F.max("label").alias("label"))  # six languages at most
    wrong = F.col("label").isNull() | ~F.array_contains("languages", F.col("label")) | (F.size("languages") > 1)
    return per.where(wrong).select("note_id", F.explode("languages").alias("language"))
