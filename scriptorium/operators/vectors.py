"""The conditions of :mod:`rules` over whole columns of a batch, outside the JVM.

Words are numbers of a list of distinct words, so a test on a word is made once for each of them.
The logic has three values: a test is a pair of masks, where it is true and where it is false.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Test(NamedTuple):
    true: np.ndarray
    false: np.ndarray


class Number(NamedTuple):
    value: np.ndarray
    null: np.ndarray


class Words(NamedTuple):
    """``code`` numbers the entries of ``words``, -1 is null."""

    code: np.ndarray
    words: list[str]


def integers(column: pa.Array) -> Number:
    null = column.is_null().to_numpy(zero_copy_only=False)
    return Number(column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), null)


def encoded(column: pa.Array) -> Words:
    d = column.dictionary_encode()
    return Words(d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist())


def together(columns: list[Words]) -> list[Words]:
    """The same columns over one list of words."""
    if all(c.words is columns[0].words for c in columns):
        return columns
    names: dict[str, int] = {}
    maps = [np.array([*[names.setdefault(w, len(names)) for w in c.words], -1], np.int64) for c in columns]
    words = list(names)
    return [Words(m[c.code], words) for m, c in zip(maps, columns)]


_TOKEN = re.compile(r"\s*('(?:[^']|'')*'|\"[^\"]*\"|\d+\.\d+|\d+|[A-Za-z_][A-Za-z_0-9]*|<=>|<>|<=|>=|[=<>+\-(),])")


@lru_cache(None)
def parsed(sql: str) -> tuple:
    """The condition as nested tuples, equal parts being equal tuples."""
    tokens, at = [], 0
    while sql[at:].strip():
        m = _TOKEN.match(sql, at)
        if not m:
            raise ValueError(f"cannot read {sql[at : at + 40]!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.append("")
    k = 0

    def peek(*words: str) -> bool:
        return tokens[k].upper() in words

    def take(*words: str) -> str:
        nonlocal k
        if words and not peek(*words):
            raise ValueError(f"{words} expected in {sql!r}, not {tokens[k]!r}")
        k += 1
        return tokens[k - 1]

    def chain(word: str, part) -> tuple:
        x = part()
        while peek(word):
            take()
            x = (word, x, part())
        return x

    def either() -> tuple:
        return chain("OR", lambda: chain("AND", negated))

    def negated() -> tuple:
        if peek("NOT"):
            take()
            return ("NOT", negated())
        return compared()

    def compared() -> tuple:
        x = added()
        while True:
            if peek("=", "<>", "<", ">", "<=", ">=", "<=>"):
                x = (take(), x, added())
            elif peek("IS"):
                take()
                no = peek("NOT") and bool(take())
                take("NULL")
                x = ("NOT", ("NULL", x)) if no else ("NULL", x)
            elif peek("IN", "LIKE", "NOT"):
                no = peek("NOT") and bool(take())
                if take("IN", "LIKE").upper() == "LIKE":
                    y = ("LIKE", x, added())
                else:
                    take("(")
                    y = ("IN", x, tuple(arguments()))
                x = ("NOT", y) if no else y
            else:
                return x

    def added() -> tuple:
        x = single()
        while peek("+", "-"):
            x = (take(), x, single())
        return x

    def arguments() -> list:
        out = [either()]
        while peek(","):
            take()
            out.append(either())
        take(")")
        return out

    def single() -> tuple:
        t = take()
        if t == "(":
            x = either()
            take(")")
            return x
        if t[0] in "'\"":
            return ("word", t[1:-1].replace("''", "'"))
        if t[0].isdigit():
            return ("number", float(t) if "." in t else int(t))
        if t.upper() == "NULL":
            return ("nothing",)
        if t.upper() == "CASE":
            what = None if peek("WHEN") else either()
            cases, last = [], ("nothing",)
            while peek("WHEN"):
                take()
                when = either()
                take("THEN")
                cases.append((when if what is None else ("=", what, when), either()))
            if peek("ELSE"):
                take()
                last = either()
            take("END")
            return ("CASE", tuple(cases), last)
        if peek("("):
            take()
            return ("call", t.upper(), tuple(arguments()))
        return ("column", t)

    out = either()
    take("")
    return _counted(out)


#: Each part of the conditions read so far once, and by its id in how many places it stands; only the
#: values of what stands in several are kept.
_parts: dict[tuple, tuple] = {}
_uses: Counter = Counter()


def _counted(x: tuple) -> tuple:
    known = x in _parts
    if not known:
        y = tuple(_counted(part) if isinstance(part, tuple) else part for part in x)
        _parts[y] = y
    x = _parts[x]
    _uses[id(x)] += 1
    return x


class Batch:
    """Columns of ``n`` rows by name, and the values of conditions over them; parts that several conditions
    share are computed once."""

    def __init__(self, n: int, columns: dict) -> None:
        self.n, self.columns, self.known, self.tests = n, columns, {}, {}
        self.none = np.zeros(n, bool)

    def __call__(self, sql: str):
        return self.value(parsed(sql))

    def value(self, x: tuple):
        if x[0] == "column":
            return self.column(x[1])
        v = self.known.get(id(x))
        if v is None:
            v = self.made(x)
            if _uses[id(x)] > 1:
                self.known[id(x)] = v
        return v

    def column(self, name: str):
        c = self.columns[name]
        return c() if callable(c) else c

    def of_words(self, column: Words, what: tuple, test) -> np.ndarray:
        """``test`` of the list of distinct words, for each row; false for null."""
        key = (id(column.words), what)
        if key not in self.tests:
            self.tests[key] = (np.append(np.asarray(test(column.words), bool), False), column.words)  # the list is kept, and so its id
        return self.tests[key][0][column.code]

    def _by_word(self, column: Words, what: tuple, test) -> Test:
        true = self.of_words(column, what, test)
        return Test(true, ~true & (column.code >= 0))

    def made(self, x: tuple):
        kind = x[0]
        if kind == "AND":
            a, b = self.value(x[1]), self.value(x[2])
            return Test(a.true & b.true, a.false | b.false)
        if kind == "OR":
            a, b = self.value(x[1]), self.value(x[2])
            return Test(a.true | b.true, a.false & b.false)
        if kind == "NOT":
            a = self.value(x[1])
            return Test(a.false, a.true)
        if kind == "NULL":
            null = self.null(self.value(x[1]))
            return Test(null, ~null)
        if kind == "IN":
            a = self.value(x[1])
            if isinstance(a, Words):
                listed = {v[1] for v in x[2]}
                return self._by_word(a, ("IN", x[2]), lambda ws: [w in listed for w in ws])
            hit = np.isin(a.value, [v[1] for v in x[2]])
            return Test(hit & ~a.null, ~hit & ~a.null)
        if kind == "LIKE":
            pattern = re.compile(re.escape(x[2][1]).replace("%", ".*").replace("_", "."), re.DOTALL)
            return self._by_word(self.value(x[1]), ("LIKE", x[2]), lambda ws: [bool(pattern.fullmatch(w)) for w in ws])
        if kind in ("=", "<>", "<", ">", "<=", ">=", "<=>"):
            return self.compared(kind, x[1], x[2])
        if kind in "+-":
            a, b = self.value(x[1]), self.value(x[2])
            return Number(a.value + b.value if kind == "+" else a.value - b.value, a.null | b.null)
        if kind == "number":
            return Number(np.full(self.n, x[1]), self.none)
        if kind == "word":
            return Words(np.zeros(self.n, np.int64), [x[1]])
        if kind == "CASE":
            return self.case(x[1], x[2])
        if kind == "call":
            return self.call(x[1], x[2])
        raise ValueError(f"what is {x!r}?")

    def null(self, v) -> np.ndarray:
        return v.code < 0 if isinstance(v, Words) else v.null if isinstance(v, Number) else ~(v.true | v.false)

    def compared(self, how: str, x: tuple, y: tuple) -> Test:
        a = self.value(x)
        if isinstance(a, Words) and y[0] == "word" and how in ("=", "<>"):
            t = self._by_word(a, ("IN", (y,)), lambda ws: [w == y[1] for w in ws])
            return t if how == "=" else Test(t.false, t.true)
        b = self.value(y)
        if isinstance(a, Words):
            if how not in ("=", "<>", "<=>"):
                raise ValueError(f"words are not compared by {how}")
            (p, _), (q, _) = together([a, b])
            null, same = (p < 0) | (q < 0), p == q
            if how == "<=>":
                return Test(same, ~same)
        else:
            null = a.null | b.null
            if how in ("<", ">", "<=", ">="):
                hit = {"<": np.less, ">": np.greater, "<=": np.less_equal, ">=": np.greater_equal}[how](a.value, b.value)
                return Test(hit & ~null, ~hit & ~null)
            same = a.value == b.value
            if how == "<=>":
                same = (same & ~null) | (a.null & b.null)
                return Test(same, ~same)
        t = Test(same & ~null, ~same & ~null)
        return t if how == "=" else Test(t.false, t.true)

    def case(self, cases: tuple, last: tuple):
        values = [None if v == ("nothing",) else self.value(v) for v in (*[v for _, v in cases], last)]
        like = next(v for v in values if v is not None)
        if isinstance(like, Test):
            raise ValueError("a test in place of a value")
        if isinstance(like, Words):
            there = together([v for v in values if v is not None])
            words = there[0].words
            there = iter(there)
            values = [np.full(self.n, -1) if v is None else next(there).code for v in values]
            out = values[-1].copy()
            for (when, _), v in zip(reversed(cases), reversed(values[:-1])):
                out = np.where(self.value(when).true, v, out)
            return Words(out, words)
        empty = Number(np.zeros(self.n, like.value.dtype), ~self.none)
        values = [empty if v is None else v for v in values]
        out, null = values[-1]
        for (when, _), v in zip(reversed(cases), reversed(values[:-1])):
            true = self.value(when).true
            out, null = np.where(true, v.value, out), np.where(true, v.null, null)
        return Number(out, null)

    def call(self, name: str, args: tuple):
        if name == "RX":
            def matches(words: list[str]):
                if not words:
                    return []
                ended = pc.replace_substring_regex(pa.array(words, pa.string()), r"(\r\n|[\n\r\x{85}\x{2028}\x{2029}])$", "")  # the JVM's $ stands before a last line end too
                return pc.match_substring_regex(ended, args[1][1]).to_numpy(zero_copy_only=False)

            return self._by_word(self.value(args[0]), ("RX", args[1]), matches)
        values = [self.value(a) for a in args]
        if name == "START":
            a = values[0]
            cut = [w[: args[1][1]] for w in a.words]
            names = {w: k for k, w in enumerate(dict.fromkeys(cut))}
            return Words(np.array([*[names[w] for w in cut], -1], np.int64)[a.code], list(names))
        if name == "LENGTH":
            a = values[0]
            return Number(np.array([*map(len, a.words), 0], np.int64)[a.code], a.code < 0)
        if name in ("LEAST", "GREATEST"):
            out, null = values[0]
            pick = np.minimum if name == "LEAST" else np.maximum
            for v in values[1:]:
                out = np.where(null, v.value, np.where(v.null, out, pick(out, v.value)))
                null = null & v.null
            return Number(out, null)
        if name == "COALESCE":
            if isinstance(values[0], Words):
                values = together(values)
                out = values[0].code
                for v in values[1:]:
                    out = np.where(out < 0, v.code, out)
                return Words(out, values[0].words)
            out, null = values[0]
            for v in values[1:]:
                out, null = np.where(null, v.value, out), null & v.null
            return Number(out, null)
        if name == "CONCAT":
            out = values[0]
            for v in values[1:]:
                n = max(len(v.words), 1)
                out = Words(np.where((out.code < 0) | (v.code < 0), -1, out.code * n + v.code), [a + b for a in out.words for b in v.words])
            return out
        raise ValueError(f"{name} is not known")
