"""Byte-level BPE ids of whole corpora, by dynamic programming over prefixes.

Method: a text falls into pieces by the vocabulary's public pattern. For each prefix of a piece the
one token that ends its encoding is found: an automaton over all tokens gives those that end at the
prefix's last byte, the longest first, and the first that is compatible with the last token of the
prefix before it is the one (two tokens are compatible if encoding their joined bytes gives the two
again). Following these back from the end of the piece gives the exact ids; no merges are replayed
over the text. Pieces met before come from a table kept per Python worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern of the public vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the piece table after which it is emptied; bounds the worker's memory, not the result.
TABLE_ENTRIES = 400_000


class PrefixEncoder:
    """Exact byte-pair encoding of pieces over a rank vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        # each token's two parts under its merge; single bytes have none
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for tok, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(tok) > 1 and (ab := self._split(tok, i)):
                self.parts[i] = ab
                self.merge[ab] = i
        reachable = [t for t, i in ranks.items() if len(t) == 1 or i in self.parts]
        self.automaton = ahocorasick.Automaton()
        for t in reachable:
            self.automaton.add_word(t.decode("latin-1"), (ranks[t], len(t)))
        self.automaton.make_automaton()
        self.compatible = lru_cache(1 << 18)(self._compatible)

    def _split(self, tok: bytes, own: int) -> tuple[int, int] | None:
        """The two tokens that merge into ``tok`` when only lower ranks are at hand."""
        parts = [tok[k : k + 1] for k in range(len(tok))]
        while len(parts) > 2:
            best = min(((self.ranks.get(parts[k] + parts[k + 1], own), k) for k in range(len(parts) - 1)), default=(own, 0))
            if best[0] >= own:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether encoding the joined bytes of two tokens keeps them apart.

        Undoes merges from the latest rank on, looking at the seam: a pair across it that would have
        merged earlier than the merges still in place makes the tokens incompatible.
        """
        limit = 1 << 62
        while True:
            if (m := self.merge.get((left, right))) is not None and m < limit:
                return False
            # undo the later of the two outer merges
            if left > right:
                limit = left
                if (ab := self.parts.get(left)) is None:
                    limit = right + 1
                    if (ab := self.parts.get(right)) is None:
                        return True
                    right = ab[0]
                else:
                    left = ab[1]
            else:
                limit = right + 1
                if (ab := self.parts.get(right)) is None:
                    limit = left
                    if (ab := self.parts.get(left)) is None:
                        return True
                    left = ab[1]
                else:
                    right = ab[0]

    def encode(self, piece: str) -> list[int]:
        """The ids of one piece; an empty piece has none. A byte that the vocabulary lacks raises."""
        raw = piece.encode("utf-8")
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        n = len(raw)
        last = [(-1, 0)] * (n + 1)  # per prefix: its last token and that token's length
        at, ends = 0, []
        for end, tok in self.automaton.iter(raw.decode("latin-1")):
            if end + 1 != at:
                self._place(last, at, ends)
                at, ends = end + 1, []
            ends.append(tok)
        self._place(last, at, ends)
        out = []
        while n:
            tok, size = last[n]
            if not size:
                raise ValueError(f"the vocabulary has no token for a byte of {raw!r}")
            out.append(tok)
            n -= size
        return out[::-1]

    def _place(self, last: list, at: int, ends: list) -> None:
        for tok, size in sorted(ends, key=lambda x: -x[1]):
            start = at - size
            if start == 0 or (last[start][1] and self.compatible(last[start][0], tok)):
                last[at] = (tok, size)
                return


@lru_cache(2)
def encoder_of(data: bytes) -> PrefixEncoder:
    """One encoder per process and vocabulary."""
    return PrefixEncoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)})


def encoder(folder: str, vocabulary: str) -> PrefixEncoder:
    """The encoder of a vocabulary file."""
    return encoder_of(Path(folder, vocabulary).read_bytes())


def _tables(data: bytes):
    import regex

    enc, known = encoder_of(data), {}
    pieces = regex.compile(PIECES).findall

    def ids_of(text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        parts = pieces(text)
        try:
            for p in parts:
                out += known[p]
            return out
        except KeyError:
            pass
        if len(known) > TABLE_ENTRIES:
            known.clear()
        for p in set(parts):
            if p not in known:
                known[p] = enc.encode(p)
        return [i for p in parts for i in known[p]]

    return ids_of


def encode_documents(df: DataFrame, document: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(document, ids)``, or with ``counts_only`` ``(document, n_tokens)``, one row for each row.

    No special tokens are put in, and their strings in a text are ordinary text. Null and empty
    texts have the empty list (0 tokens). Texts are encoded whole, repeated rows each time; columns
    named in ``keep`` come along. No shuffle. The vocabulary (a file of fixed size) is read here and
    sent along, so that the machines of the cluster need no copy of it.
    """
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(Path(folder, vocabulary).read_bytes())

    source = df.select(F.col(f"`{document}`").alias(document), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    schema = ", ".join([*kept, "n_tokens bigint" if counts_only else "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ids_of = _tables(shared.value)
        for batch in batches:
            sizes = np.zeros(batch.num_rows + 1, dtype=np.int64)
            flat: list[np.ndarray] = []
            for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                ids = ids_of(t)
                sizes[k + 1] = len(ids)
                if not counts_only:
                    flat.append(np.asarray(ids, dtype=np.int32))
            if counts_only:
                new = pa.array(sizes[1:])
            else:
                values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
                new = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(values))
            names = [*batch.schema.names[:-1], "n_tokens" if counts_only else "ids"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], new], names=names)

    return map_batches(source, run, schema)


def token_count(df: DataFrame, document: str, text: str, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """``(document, keep..., n_tokens)``; see :func:`encode_documents`."""
    return encode_documents(df, document, text, counts_only=True, keep=keep, **options)

