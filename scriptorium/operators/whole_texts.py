"""All that is found in whole texts, batch by batch: the findings of :mod:`constructions`, the figures of
:mod:`figures` and the anomalies of :mod:`gate`, by index operations over the tokens of many texts.

The rows of a text come together and in order; what is held is a batch and one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import lexicon as L
from ..session import whole_groups
from .rules import DEGREE_SQL, FAMILIES, GENITIVE_TOO, GERUND_CASE_SQL, GERUNDIVE_SQL, SPECIAL, within
from .token_context import FETCHED, FLAGS, Sentences
from .vectors import Batch, Number, Test, Words, encoded, integers, together

#: Tokens that are looked at together, so that what each look-up costs besides is small.
ROWS = 5_000

RAW = {"i": "int", "text": "string", "lemma": "string", "pos": "string", "dep": "string", "head": "int", "morph": "string"}
WORDS = ("text", "form", "l", "pos", "dep", "ent", "cas", "num", "gen", "person", "tense", "voice", "mood", "aspect", "vf", "pt")
#: The columns by which rows at one place of a sentence come in order, as :func:`token_context` has it.
ORDER = (*WORDS, "may_gen")
TOKEN = pa.struct([*[(c, {"int": pa.int32(), "string": pa.string()}[t]) for c, t in RAW.items()], ("constructions", pa.string())])
FINDING = pa.struct([("key", pa.string()), ("anchor", pa.int32()), ("tokens", pa.string()), ("confidence", pa.float64()), ("label", pa.string())])
FIGURE = pa.struct([("key", pa.string()), ("tokens", pa.string()), ("confidence", pa.float64())])
ANOMALY = pa.struct([("sent_id", pa.int64()), ("i", pa.int32()), ("kind", pa.string()), ("feature", pa.string())])
SENTENCES = pa.list_(pa.struct([("sent_id", pa.int64()), ("tokens", pa.list_(TOKEN)), ("findings", pa.list_(FINDING)), ("figures", pa.list_(FIGURE))]))

PER_TEXT = (
    "sentences array<struct<sent_id: bigint, tokens: array<struct<i: int, text: string, lemma: string, pos: string, dep: string, head: int, morph: string, constructions: string>>, "
    "findings: array<struct<key: string, anchor: int, tokens: string, confidence: double, label: string>>, figures: array<struct<key: string, tokens: string, confidence: double>>>>, "
    "anomalies array<struct<sent_id: bigint, i: int, kind: string, feature: string>>"
)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in a key."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks()


def _lists(group: np.ndarray, n: int, values: pa.Array, empty_is_null: bool = False) -> pa.Array:
    """Values that lie in the order of their groups, numbers below ``n``, as one list a group."""
    sizes = np.bincount(group, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(sizes == 0) if empty_is_null else None)


def _ranks(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place in the order of the distinct ones, null first, and the values as a dictionary."""
    d = values.dictionary_encode()
    words = d.dictionary.to_pylist()
    rank = np.empty(len(words) + 1, np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    rank[-1] = -1
    return rank[d.indices.fill_null(-1).to_numpy(zero_copy_only=False)], d


class Found:
    """Rows that were found, gathered from many tests: (sentence, key, tokens) and what belongs to them."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []

    def add(self, sentence, key: str, tokens, confidence, *more) -> None:
        if len(sentence):
            self.parts.append((sentence, key, tokens, np.broadcast_to(np.asarray(confidence, np.float64), len(sentence)), *more))

    def column(self, k: int, kind=np.int64) -> np.ndarray:
        return np.concatenate([p[k] for p in self.parts]) if self.parts else np.empty(0, kind)

    def keys(self) -> tuple[np.ndarray, list[str]]:
        """The numbers of the keys in the order of the alphabet, and the keys."""
        names = sorted({p[1] for p in self.parts})
        number = {w: k for k, w in enumerate(names)}
        return np.repeat([number[p[1]] for p in self.parts], [len(p[0]) for p in self.parts]).astype(np.int64), names


def _joined(numbers: list[Number], separator: str = ",") -> pa.Array:
    """The numbers of each row as one text; nulls are passed over."""
    return pc.binary_join_element_wise(*[pa.array(v.value.astype(np.int64), mask=v.null).cast(pa.string()) for v in numbers], separator, null_handling="skip")


def _grouped(group: np.ndarray, numbers: np.ndarray, n: int) -> pa.Array:
    """The numbers of each group, in the order of groups, as one text."""
    return pc.binary_join(_lists(group, n, pa.array(numbers.astype(np.int64)).cast(pa.string())), ",")


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers from each ``lo`` to below its ``hi``, one after the other."""
    size = hi - lo
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _firsts(sentence: np.ndarray, most: int) -> np.ndarray:
    """The first rows of each sentence, the rows being in order."""
    start = np.flatnonzero(_starts(sentence))
    nth = np.arange(len(sentence)) - np.repeat(start, np.diff(np.append(start, len(sentence))))
    return np.flatnonzero(nth < most)


# ---- constructions


def context(b: Batch, s: Sentences) -> None:
    """Add the columns that stand for other tokens of the sentence."""

    def fetched(which: str, of: str):
        p, c = s[which], b.column(of)
        if isinstance(c, Words):
            return Words(s.of(p, c.code), c.words)
        return Number(s.of(p, c.value, 0), s.of(p, c.null, True).astype(bool))

    for name, (which, of) in FETCHED.items():
        b.columns[name] = lambda which=which, of=of, name=name: b.columns.__setitem__(name, v := fetched(which, of)) or v


def findings(b: Batch, sentence: np.ndarray) -> Found:
    """The findings of all rules, without those that give way to a more special clause."""
    out = Found()
    special = np.empty(0, np.int64)
    late = []

    def add(rule, rows: np.ndarray) -> None:
        nonlocal special
        if not len(rows):
            return
        pick = lambda v: Number(v.value[rows], v.null[rows])
        tokens, anchor, conf, label = [pick(b(t)) for t in rule.tokens], pick(b(rule.anchor)), b(rule.conf).value[rows], b(rule.label)
        label = Words(label.code[rows], label.words)
        row = (sentence[rows], rule.key, tokens, conf, anchor, label)
        if rule.key in SPECIAL:
            special = np.append(special, ((sentence[rows] << 33) + anchor.value)[~anchor.null])
        if rule.key in ("purpose_clause", "result_clause"):
            late.append(row)
            return
        out.add(*row)
        if rule.key == "genitive_subjective":
            out.add(row[0], GENITIVE_TOO[0].key, tokens, 0.5, anchor, label)

    for alone, cascade in FAMILIES.values():
        for r in alone:
            add(r, np.flatnonzero(b(r.when).true))
        free = np.ones(b.n, bool)
        for r in cascade or []:
            true = b(r.when).true
            if r.key:
                add(r, np.flatnonzero(true & free))
            free &= ~true
        b.known.clear()  # families share little
    for rows, key, tokens, conf, anchor, label in late:
        kept = np.flatnonzero(anchor.null | ~np.isin((rows << 33) + anchor.value, special))
        pick = lambda v, kept=kept: type(v)(v[0][kept], v[1][kept])
        out.add(rows[kept], key, [pick(t) for t in tokens], conf[kept], pick(anchor), Words(label.code[kept], label.words))
    return out


def _findings_and_tags(found: Found, n: int) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The findings of each of ``n`` sentences by falling confidence, key and so on; and the places of
    tokens, as sentence and place in one number, with the keys of their findings."""
    key, names = found.keys()
    sentence, conf = found.column(0), found.column(3, np.float64)
    most = max((len(p[2]) for p in found.parts), default=0)
    nothing = lambda p: Number(np.zeros(len(p[0]), np.int64), np.ones(len(p[0]), bool))
    places = [[p[2][k] if k < len(p[2]) else nothing(p) for p in found.parts] for k in range(most)]
    places = [Number(np.concatenate([v.value for v in vs]), np.concatenate([v.null for v in vs])) for vs in places]
    anchor = Number(np.concatenate([p[4].value for p in found.parts]), np.concatenate([p[4].null for p in found.parts])) if found.parts else Number(*[np.empty(0, k) for k in (np.int64, bool)])
    labels = together([p[5] for p in found.parts]) if found.parts else [Words(np.empty(0, np.int64), [])]
    label = pa.array(labels[0].words, pa.string()).take(pa.array(np.concatenate([x.code for x in labels]), mask=np.concatenate([x.code for x in labels]) < 0))
    tokens = _joined(places) if places else pa.array([], pa.string())
    order = np.lexsort([_ranks(label)[0], _ranks(tokens)[0], np.where(anchor.null, -(1 << 62), anchor.value), key, -conf, sentence])
    at = pa.array(order)
    values = pa.StructArray.from_arrays(
        [pa.array(names, pa.string()).take(pa.array(key[order])), pa.array(anchor.value[order].astype(np.int32), mask=anchor.null[order]), tokens.take(at), pa.array(conf[order]), label.take(at)], fields=list(FINDING)
    )
    lists = _lists(sentence, n, values, empty_is_null=True)
    there = [np.flatnonzero(~v.null) for v in places]
    place = np.concatenate([(sentence[t] << 33) + v.value[t] for t, v in zip(there, places)]) if places else np.empty(0, np.int64)
    keys = np.concatenate([key[t] for t in there]) if places else np.empty(0, np.int64)
    # a number of the place in order and the key, so that one sort serves
    distinct, number = np.unique(place, return_inverse=True)
    both = np.sort(number * max(len(names), 1) + keys)
    group, keys = both // max(len(names), 1), both % max(len(names), 1)
    tags = pc.binary_join(_lists(group, len(distinct), pa.array(names, pa.string()).take(pa.array(keys))), ",")
    return lists, distinct, tags


# ---- figures


@lru_cache(1 << 15)
def _sound(form: str) -> str:
    m = re.match("qu|ch|ph|th|gn|sc|sp|st|[^\n\r\x85\u2028\u2029]", form)
    return m[0] if m else ""


@lru_cache(1 << 15)
def _vowels(form: str) -> tuple[int, ...]:
    """How often each vowel stands in the form, and where first."""
    return (*(form.count(v) for v in "aeiou"), *(p if (p := form.find(v)) >= 0 else 1 << 20 for v in "aeiou"))


def figures(b: Batch, sentence: np.ndarray, n: int) -> tuple[Found, np.ndarray]:
    """The figures inside ``n`` sentences: (sentence, key, tokens as text, confidence); and the places, as
    sentence and place in one number, of the tokens in a hyperbaton.

    ``b`` has all distinct tokens in order, ``sentence`` the number of each one's sentence.
    """
    out = Found()
    place, head = b.column("i").value, b.column("head")
    true = lambda sql: b(sql).true
    key = (sentence << 33) + place
    asked = (sentence << 33) + head.value
    has_head = ~head.null & (key[np.minimum(np.searchsorted(key, asked), max(b.n - 1, 0))] == asked) if b.n else head.null
    text = lambda *values: _joined([Number(v, np.zeros(len(v), bool)) for v in values])
    every = lambda mask, name, conf: out.add(sentence[r := np.flatnonzero(mask)], name, text(place[r]), conf)
    size = lambda mask: np.bincount(sentence[mask], minlength=n)

    def listed(rows: np.ndarray, name: str, conf: float) -> None:
        """One figure for each sentence of the rows, of all of them."""
        if len(rows):
            new = _starts(sentence[rows])
            out.add(sentence[rows][new], name, _grouped(np.cumsum(new) - 1, place[rows], int(new.sum())), conf)

    # order
    pair = true("pos IN ('ADJ', 'DET', 'NUM') AND dep IN ('amod', 'det', 'nummod')") & has_head
    far = np.flatnonzero(pair & (np.abs(place - head.value) - 1 >= 3))
    out.add(sentence[far], "hyperbaton", text(place[far], head.value[far]), 0.7)
    apart = np.unique(np.append((sentence[far] << 33) + place[far], (sentence[far] << 33) + head.value[far]))
    crossed = np.flatnonzero(pair & (np.abs(place - head.value) > 1))
    crossed = crossed[np.bincount(sentence[crossed], minlength=n)[sentence[crossed]] > 1]
    rows: list[tuple] = []
    for group in np.split(crossed, np.flatnonzero(_starts(sentence[crossed]))[1:]) if len(crossed) else []:
        ends, got = list(zip(place[group].tolist(), head.value[group].tolist())), 0
        for k, p in enumerate(ends):
            for q in ends[k + 1 :] if got < 3 else []:
                four = sorted([(p[0], "A"), (p[1], "a"), (q[0], "B"), (q[1], "b")])
                shape = "".join(c for _, c in four)
                if got < 3 and four[3][0] - four[0][0] <= 8 and len({i for i, _ in four}) == 4 and shape in ("ABba", "BAab", "ABab", "BAba"):
                    rows.append((int(sentence[group[0]]), "chiasmus" if shape in ("ABba", "BAab") else "synchysis", ",".join(str(i) for i, _ in four)))
                    got += 1
    for name in ("chiasmus", "synchysis"):
        some = [r for r in rows if r[1] == name]
        out.add(np.array([r[0] for r in some], np.int64), name, pa.array([r[2] for r in some], pa.string()), 0.65)
    after = np.flatnonzero(true("dep = 'case' AND pos = 'ADP'") & has_head & (place == head.value + 1))
    out.add(sentence[after], "anastrophe", text(head.value[after], place[after]), 0.75)

    # the words of sentences that are no signs
    w = np.flatnonzero(true("pos NOT IN ('PUNCT', 'X') AND text <> ''"))
    ws, m = sentence[w], len(w)
    n_words = np.bincount(ws, minlength=n)
    nth = np.arange(m) - np.concatenate([[0], np.cumsum(n_words)])[:-1][ws]
    same = lambda k: np.append(ws[k:] == ws[: max(m - k, 0)], np.zeros(min(k, m), bool))
    shifted = lambda v, k: np.append(v[k:], np.zeros(min(k, m), v.dtype))
    pos, cas, l, form = (b.column(c) for c in ("pos", "cas", "l", "form"))
    in_pos = lambda *names: b(f"pos IN ({', '.join(map(repr, names))})").true[w]
    five = np.flatnonzero((n_words[ws] == 5) & (nth == 0))
    adj, verb, noun = in_pos("ADJ", "ADJ"), in_pos("VERB", "AUX"), in_pos("NOUN", "PROPN")
    five = five[adj[five] & adj[five + 1] & verb[five + 2] & noun[five + 3] & noun[five + 4]]
    c = cas.code[w]
    out.add(ws[five], "golden_line", text(*[place[w][five + k] for k in range(5)]), np.where((c[five] == c[five + 4]) & (c[five + 1] == c[five + 3]), 0.8, 0.5))

    # words
    nominal = np.flatnonzero(true("pos IN ('NOUN', 'PROPN', 'ADJ', 'PRON', 'VERB') AND length(l) > 2"))
    by = nominal[np.lexsort([nominal, l.code[nominal], sentence[nominal]])]
    if len(by):
        start = np.flatnonzero(_starts(sentence[by], l.code[by]))
        sizes = np.diff(np.append(start, len(by)))
        least, most = (f.reduceat(place[by], start) for f in (np.minimum, np.maximum))
        one, other = (f.reduceat(form.code[by], start) for f in (np.minimum, np.maximum))
        good = np.flatnonzero((sizes >= 2) & (one != other) & (most - least <= 10))
        good = good[np.argsort(by[start[good]], kind="stable")]  # by the first word
        good = good[_firsts(sentence[by[start[good]]], 3)]
        members = by[_spans(start[good], start[good] + sizes[good])]
        out.add(sentence[by[start[good]]], "polyptoton", _grouped(np.repeat(np.arange(len(good)), sizes[good]), place[members], len(good)), 0.7)
    negator, negative = true(within("l", L.NEGATORS)), true(within("l", L.NEGATIVE_SENSE))
    denied, d = np.full(b.n, -1), 1
    while d < b.n:  # a few steps, more only where places repeat
        there = np.flatnonzero((sentence[d:] == sentence[:-d]) & (place[d:] <= place[:-d] + 2))
        if not len(there):
            break
        hit = there[(denied[there] < 0) & negative[there + d] & (place[there + d] > place[there])]
        denied[hit], d = hit + d, d + 1
    r = np.flatnonzero(negator & (denied >= 0))
    out.add(sentence[r], "litotes", text(place[r], place[denied[r]]), 0.7)
    every(true(within("l", L.SIMILE_MARKERS)), "simile", 0.7)
    called = np.flatnonzero(true("cas = 'Voc' AND dep NOT IN ('nsubj', 'nsubj:pass') AND pos IN ('NOUN', 'PROPN', 'PRON', 'ADJ')"))
    called = called[_firsts(sentence[called], 3)]
    out.add(sentence[called], "apostrophe", text(place[called]), 0.7)
    no_verb = (n_words >= 3) & (size(true("vf LIKE '%Fin%'")) == 0)
    listed(w[no_verb[ws] & (nth < 6)], "ellipsis", 0.6)

    # coordination
    links = true("dep = 'cc' OR l IN ('et', 'que', 'atque', 'ac')")
    n_links = size(links)
    listed(np.flatnonzero(links & (n_links >= 3)[sentence]), "polysyndeton", 0.6)
    conj = np.flatnonzero(true("dep = 'conj'"))
    free = n_links == 0
    n_conj = np.bincount(sentence[conj], minlength=n)
    of = conj[(free & (n_conj >= 2))[sentence[conj]]]
    if len(of):
        first = of[_starts(sentence[of])]
        known = first[~head.null[first]]
        heads = _spans(np.searchsorted(key, asked[known], "left"), np.searchsorted(key, asked[known], "right"))
        every_row = np.concatenate([heads, of])
        order = np.lexsort([np.arange(len(every_row)), sentence[every_row]])
        listed(every_row[order], "asyndeton", 0.65)
    content = np.flatnonzero(true("pos IN ('VERB', 'NOUN', 'ADJ', 'PROPN', 'ADV', 'NUM') AND text <> ','") & (free & (n_conj < 2))[sentence])
    if len(content):
        commas = key[true("text = ','")]
        before = np.searchsorted(commas, key[content])
        new = _starts(sentence[content], before)  # commas before a token grow along the sentence
        distinct, total = np.bincount(sentence[content[new]], minlength=n), np.bincount(sentence[content], minlength=n)
        listed(content[((distinct >= 3) & (distinct == total))[sentence[content]]], "asyndeton", 0.65)
    joined = conj[has_head[conj]]
    if len(joined):
        by = joined[np.lexsort([joined, head.value[joined], sentence[joined]])]
        start = np.flatnonzero(_starts(sentence[by], head.value[by]))
        two = start[np.diff(np.append(start, len(by))) == 2]
        out.add(sentence[by[two]], "tricolon", text(head.value[by[two]], place[by[two]], place[by[two + 1]]), 0.6)

    # sound
    wl, wf = l.code[w], form.code[w]
    ending = {e: k for k, e in enumerate(dict.fromkeys(f[-3:] for f in form.words if len(f) >= 3))}
    end = np.array([*[ending[f[-3:]] if len(f) >= 3 else -1 for f in form.words], -1], np.int64)[wf]
    rhyme = np.full(m, -1)
    for k in (3, 2, 1):
        hit = np.flatnonzero(same(k) & (end >= 0) & (end == shifted(end, k)) & (wl >= 0) & (shifted(wl, k) >= 0) & (wl != shifted(wl, k)))
        rhyme[hit] = hit + k
    r = np.flatnonzero(rhyme >= 0)
    r = r[_firsts(ws[r], 3)]
    out.add(ws[r], "homoeoteleuton", text(place[w[r]], place[w[rhyme[r]]]), 0.45)

    count = np.array([*map(_vowels, form.words), (0,) * 5 + (1 << 20,) * 5], np.int64).reshape(-1, 10)[wf]
    total, least = count[:, :5].copy(), count[:, :5].copy()
    for k in (1, 2, 3):
        inside = same(k)[:, None]
        moved = np.concatenate([count[k:, :5], np.zeros((min(k, m), 5), np.int64)])
        total += np.where(inside, moved, 0)
        least = np.where(inside, np.minimum(least, moved), least)
    where = np.where(least > 0, count[:, 5:], 1 << 21)
    vowel = where.argmin(1) if m else np.empty(0, np.int64)
    rows = np.arange(m)
    r = np.flatnonzero((n_words[ws] >= 3) & (nth <= n_words[ws] - 3) & (where[rows, vowel] < 1 << 20) & (total[rows, vowel] >= 6))
    r = r[_firsts(ws[r], 2)]
    if len(r):
        length = np.minimum(4, n_words[ws[r]] - nth[r])
        out.add(ws[r], "assonance", _grouped(np.repeat(np.arange(len(r)), length), place[w[_spans(r, r + length)]], len(r)), 0.5)

    sounds = {x: k for k, x in enumerate(dict.fromkeys(map(_sound, form.words)))}
    sound = np.array([*[sounds[_sound(f)] for f in form.words], -1], np.int64)[wf]
    begins = b.of_words(form, ("begins",), lambda fs: [f != "" and f[0] not in "aeiouy" for f in fs])[w]
    stop = {L.folded(x) for x in L.SOUND_STOPWORDS}
    counts = b.of_words(form, ("counts",), lambda fs: [f not in stop for f in fs])[w] & (sound >= 0)
    hits = np.stack([same(k) & (sound == shifted(sound, k)) & shifted(counts, k) for k in range(1, 6)]) if m else np.empty((5, 0), bool)
    number, i_of = hits.sum(0), place[w]
    nearest = np.where(hits.any(0), hits.argmax(0) + 1, 0) if m else number
    near = i_of[np.minimum(np.arange(m) + nearest, max(m - 1, 0))] if m else i_of
    may = np.flatnonzero(begins & (number > 0) & ((number > 1) | (near - i_of <= 1)))
    places, lists, kept, last, used = i_of.tolist(), [], [], -1, set()
    hit_rows = hits[:, may].T.tolist()
    for k, own, hit in zip(may.tolist(), ws[may].tolist(), hit_rows):
        if own != last:
            last, used = own, set()
        if places[k] in used:
            continue
        g = [places[k], *[places[k + d] for d, h in enumerate(hit, 1) if h]]
        used.update(g)
        kept.append(k)
        lists.append(",".join(map(str, g)))
    more = number[kept]
    out.add(ws[kept], "alliteration", pa.array(lists, pa.string()), np.where(more == 1, 0.5, 0.6 + 0.1 * np.minimum(more - 2, 3)))
    return out, apart


def repetitions(b: Batch, sentence: np.ndarray, n: int, document: np.ndarray, sent_id: Number) -> Found:
    """Anaphora: runs of sentences of a text that open with the same word, at the first of them."""
    out, form = Found(), b.column("form")
    w = np.flatnonzero(b("pos NOT IN ('PUNCT', 'X') AND text <> ''").true)
    place = b.column("i").value[w]
    rank = np.array([*_ranks(pa.array(form.words, pa.string()))[0], -1], np.int64)[form.code[w]]
    by = w[np.lexsort([rank, place, sentence[w]])] if not _starts(sentence[w], place).all() else w
    first = by[_starts(sentence[by])] if len(by) else by
    at = sentence[first]
    new = _starts(document[at], form.code[first]) if len(first) else np.empty(0, bool)
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, len(first)))
    good = np.flatnonzero(sizes >= 2)
    rows = _spans(start[good], start[good] + sizes[good])
    i = b.column("i").value
    opening = _joined([Number(sent_id.value[at[rows]], sent_id.null[at[rows]]), Number(i[first[rows]], np.zeros(len(rows), bool))], ":") if len(rows) else pa.array([], pa.string())
    tokens = pc.binary_join(_lists(np.repeat(np.arange(len(good)), sizes[good]), len(good), opening), ",")
    own = at[start[good]]
    known = np.flatnonzero(~sent_id.null[own])
    out.add(own[known], "anaphora", tokens.take(pa.array(known)), 0.75)
    return out


def _figure_lists(parts: list[tuple], n: int) -> pa.Array:
    found = Found()
    found.parts = parts
    key, names = found.keys()
    sentence, conf = found.column(0), found.column(3, np.float64)
    tokens = pa.concat_arrays([p[2] for p in parts]) if parts else pa.array([], pa.string())
    order = np.lexsort([_ranks(tokens)[0], key, -conf, sentence])
    values = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(key[order])), tokens.take(pa.array(order)), pa.array(conf[order])], fields=list(FIGURE))
    return _lists(sentence, n, values, empty_is_null=True)


# ---- anomalies


def anomalies(b: Batch, sentence: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Modifiers that disagree with their head, but for those in a hyperbaton: (sentence, place, feature)."""
    place, head = b.column("i").value, b.column("head")
    key = (sentence << 33) + place
    mods = np.flatnonzero(b("dep IN ('amod', 'det', 'nummod') AND pos IN ('ADJ', 'DET', 'NUM')").true & ~head.null)
    mods = mods[~np.isin(key[mods], apart)]
    asked = (sentence[mods] << 33) + head.value[mods]
    lo, hi = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
    t, h = np.repeat(mods, hi - lo), _spans(lo, hi)
    feature = np.zeros(len(t), np.int64)
    for number, c in ((3, "gen"), (2, "num"), (1, "cas")):
        column = b.column(c)
        p, q = column.code[t], column.code[h]
        differ = (p >= 0) & (q >= 0) & (p != q)
        several = b.of_words(column, ("several",), lambda ws: ["," in x for x in ws])
        for k in np.flatnonzero(differ & (several[t] | several[h])):
            differ[k] = not set(column.words[p[k]].split(",")) & set(column.words[q[k]].split(","))
        feature[differ] = number
    odd = np.flatnonzero(feature)
    return sentence[t[odd]], place[t[odd]], feature[odd]


# ---- texts


def _rows(t: pa.Table, new_sentence: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The distinct tokens with a place, in order, and of each the number of its sentence; and which are
    the first at their place."""
    number = np.cumsum(new_sentence) - 1
    i = integers(_column(t, "i"))
    kept = np.flatnonzero(~i.null)
    sentence, place = number[kept], i.value[kept]
    again = ~_starts(sentence, place)
    if again.any():
        rows = np.flatnonzero(again | np.append(again[1:], False))
        values = list(zip(*[t.column(c).take(pa.array(kept[rows])).to_pylist() for c in (*ORDER, "head")]))
        low = lambda row: tuple((v is not None, v) if v is not None else (False, 0) for v in row)
        # the features that are worked out from the others come after them, so they decide nothing
        order = sorted(range(len(rows)), key=lambda k: (sentence[rows[k]], place[rows[k]], low(values[k])))
        keep = [k for n, k in enumerate(order) if not n or (sentence[rows[k]], place[rows[k]], values[k]) != (sentence[rows[order[n - 1]]], place[rows[order[n - 1]]], values[order[n - 1]])]
        new = np.concatenate([np.setdiff1d(np.arange(len(kept)), rows), rows[keep]])
        nth = np.concatenate([np.zeros(len(kept) - len(rows), np.int64), np.arange(len(keep))])
        new = new[np.lexsort([nth, place[new], sentence[new]])]
        kept, sentence, place = kept[new], sentence[new], place[new]
        again = ~_starts(sentence, place)
        t = t.take(pa.array(kept)).combine_chunks()
    elif len(kept) < t.num_rows:
        t = t.take(pa.array(kept)).combine_chunks()
    return t, sentence, ~again


def _batch(t: pa.Table) -> Batch:
    columns = {c: encoded(_column(t, c)) for c in WORDS}
    may = _column(t, "may_gen").fill_null(False).to_numpy(zero_copy_only=False)
    b = Batch(t.num_rows, columns | {"i": integers(_column(t, "i")), "head": integers(_column(t, "head")), "may_gen": Test(may, ~may)})
    for name, sql in (("gdv", GERUNDIVE_SQL), ("deg", DEGREE_SQL), ("gcas", GERUND_CASE_SQL)):
        b.columns[name] = b(sql)
    return b


def _sub(b: Batch, rows: np.ndarray) -> Batch:
    """The rows of a batch."""
    pick = lambda v: Words(v.code[rows], v.words) if isinstance(v, Words) else type(v)(v[0][rows], v[1][rows])
    return Batch(len(rows), {k: pick(v) for k, v in b.columns.items()})


def analysed(t: pa.Table) -> pa.Table:
    """``(doc_id, part, sentences, anomalies)`` for each row of whole texts that has a ``part``."""
    t = t.combine_chunks()
    doc_id = integers(_column(t, "doc_id"))
    new_doc = _starts(doc_id.value, doc_id.null)
    parted = pc.is_valid(_column(t, "part")).to_numpy(zero_copy_only=False)
    doc_of_row = np.cumsum(new_doc) - 1
    n_docs = int(new_doc.sum())
    parts, part_doc = t.select(["doc_id", "part"]).filter(pa.array(parted)).combine_chunks(), doc_of_row[parted]
    raw, doc_of_row = t.drop(["part"]).filter(pa.array(~parted)).combine_chunks(), doc_of_row[~parted]
    sent_id = integers(_column(raw, "sent_id"))
    new = _starts(doc_of_row, sent_id.value, sent_id.null)
    n, start = int(new.sum()), np.flatnonzero(new)
    document, sent_id = doc_of_row[start], Number(sent_id.value[start], sent_id.null[start])
    rows, sentence, lead = _rows(raw, new)
    every = _batch(rows)
    first = every if lead.all() else _sub(every, np.flatnonzero(lead))
    own = sentence[lead]
    cas, gcas = together([first.column("cas"), first.column("gcas")])
    flags = np.zeros(first.n, np.int64)
    for k, test in enumerate(FLAGS.values()):
        flags |= first(test).true.astype(np.int64) << k
    head = first.column("head")
    s = Sentences(np.cumsum(_starts(own)) - 1, first.column("i").value, np.where(head.null, -1, head.value), flags, cas.code, first.column("num").code, gcas.code)
    shown, apart = figures(every, sentence, n)
    shown.parts += repetitions(every, sentence, n, document, sent_id).parts
    raw_i, number = integers(_column(raw, "i")), np.cumsum(new) - 1
    placed_rows = np.flatnonzero(~raw_i.null)
    repeated = every.n < len(placed_rows)  # for anomalies repeated tokens count as often as they stand
    odd_sentence, odd_place, feature = anomalies(_batch(raw.take(pa.array(placed_rows)).combine_chunks()), number[placed_rows], apart) if repeated else anomalies(every, sentence, apart)
    finite = np.bincount(sentence[every("vf LIKE '%Fin%'").true], minlength=n) > 0
    placed = np.bincount(sentence, minlength=n) > 0
    context(first, s)
    lists, tagged, tags = _findings_and_tags(findings(first, own), n)

    key = (number << 33) + raw_i.value
    at = np.searchsorted(tagged, key)
    hit = ~raw_i.null & (tagged[np.minimum(at, max(len(tagged) - 1, 0))] == key) if len(tagged) else np.zeros(len(key), bool)
    tag = pc.fill_null(tags.take(pa.array(np.where(hit, at, 0), mask=~hit)), "")
    tokens = pa.StructArray.from_arrays([*[_column(raw, c) for c in RAW], tag], fields=list(TOKEN))
    sentences = pa.StructArray.from_arrays([pa.array(sent_id.value, mask=sent_id.null), _lists(number, n, tokens), lists, _figure_lists(shown.parts, n)], fields=list(SENTENCES.value_type))

    bare = np.flatnonzero((np.bincount(document[placed], minlength=n_docs) > 0) & (np.bincount(document[finite], minlength=n_docs) == 0))
    opening = np.flatnonzero(placed)
    opening = opening[_starts(document[opening])] if len(opening) else opening
    opening = opening[np.isin(document[opening], bare)]
    at = np.concatenate([odd_sentence, opening])
    names = ["", "Case", "Number", "Gender"]
    odd = [np.concatenate([odd_place, np.zeros(len(opening), np.int64)]), np.concatenate([np.zeros(len(odd_place), np.int64), np.ones(len(opening), np.int64)]), np.concatenate([feature, np.zeros(len(opening), np.int64)])]
    order = np.lexsort([np.array([0, 1, 3, 2])[odd[2]], odd[1], odd[0], at])  # sentences are in order, null first
    at, odd = at[order], [x[order] for x in odd]
    values = pa.StructArray.from_arrays(
        [pa.array(sent_id.value[at], mask=sent_id.null[at]), pa.array(odd[0].astype(np.int32)), pa.array(["agreement", "no_finite_verb"]).take(pa.array(odd[1])), pa.array(names).take(pa.array(odd[2]))], fields=list(ANOMALY)
    )
    irregular = _lists(document[at], n_docs, values, empty_is_null=True)
    whole = _lists(document, n_docs, sentences, empty_is_null=True)
    if len(part_doc) != n_docs or (part_doc != np.arange(n_docs)).any():
        whole, irregular = whole.take(pa.array(part_doc)), irregular.take(pa.array(part_doc))
    return pa.table([_column(parts, "doc_id"), _column(parts, "part"), whole, irregular], names=["doc_id", "part", "sentences", "anomalies"])


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches in the order of texts the results of :func:`analysed`."""
    waiting: list[pa.Table] = []
    for t in whole_groups(batches, 1):
        waiting.append(t)
        if sum(w.num_rows for w in waiting) >= ROWS:
            yield from analysed(pa.concat_tables(waiting)).to_batches()
            waiting = []
    if waiting:
        yield from analysed(pa.concat_tables(waiting)).to_batches()
