"""Token counts by rank-synchronous merging of ragged arrays of symbols."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import words as W

#: Pieces of text whose count is remembered by a Python worker; beyond it the memory starts anew.
REMEMBERED = 800_000
#: Code points of distinct pieces that are merged at once.
MERGED = 2_000_000
_NONE = np.int64(1) << np.int64(40)
SPACE = "▁"


class Vocabulary:
    """Merges of a sentencepiece BPE model as arrays.

    Two neighbouring symbols merge if their concatenation is a piece, better scores first, then
    from the left. Symbols are pieces, and characters that occur in pieces or stand alone.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in usual}
        symbols = {p: k for k, p in enumerate(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))}
        ranks = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.n = len(symbols) + 1  # the last is any other character
        self.symbol = np.full(0x110000, self.n - 1, np.int64)
        for p, k in symbols.items():
            if len(p) == 1:
                self.symbol[ord(p)] = k
        # Tokens that a symbol left over stands for: itself, or its bytes if it is no piece.
        self.known = np.zeros(self.n, bool)
        self.known[[symbols[p] for p in pieces]] = True
        found, inner = {}, set()
        for p, score in pieces.items():
            inner.update(ord(a) * 0x110000 + ord(b) for a, b in zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    found[symbols[p[:k]] * self.n + symbols[p[k:]]] = (ranks[score], symbols[p])
        keys = np.array(sorted(found), np.int64)
        self.pairs = keys
        self.rank = np.array([found[k][0] for k in keys.tolist()], np.int64)
        self.merged = np.array([found[k][1] for k in keys.tolist()], np.int64)
        self.inner = np.array(sorted(inner), np.int64)
        # Where no piece holds a space mark after another character, texts may be cut before runs of marks.
        self.cuts = not any(p[k] == SPACE != p[k - 1] for p in pieces for k in range(1, len(p)))

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; a rank of _NONE if it doesn't merge."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.rank[at], _NONE), self.merged[at]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens in each of ``texts``, which have their space marks."""
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), size)
        new = np.ones(len(code), bool)
        if len(code) > 1:  # a sequence ends where no piece has its last character and the next one side by side
            key = code[:-1] * 0x110000 + code[1:]
            at = np.minimum(np.searchsorted(self.inner, key), len(self.inner) - 1)
            new[1:] = (self.inner[at] != key) | (owner[1:] != owner[:-1])
        symbol = self.symbol[code]
        tokens = np.where(self.known[symbol], 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        out = np.bincount(owner, tokens, len(texts)).astype(np.int64)
        # Only sequences of two characters or more can merge; each merge of two pieces takes a token away.
        several = ~new | np.concatenate([~new[1:], [False]])
        symbol, sequence, owner, weight = symbol[several], np.cumsum(new)[several], owner[several], tokens[several]
        while len(symbol):
            same = sequence[1:] == sequence[:-1]
            rank = np.full(len(symbol), _NONE)
            merged = np.zeros(len(symbol), np.int64)
            at = np.flatnonzero(same)
            rank[at], merged[at] = self.look(symbol[at], symbol[at + 1])
            while True:
                starts = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
                sizes = np.diff(np.concatenate([starts, [len(symbol)]]))
                low = np.minimum.reduceat(rank, starts)
                live = np.repeat(low < _NONE, sizes)
                if not live.all():
                    symbol, sequence, owner, rank, merged, weight = (x[live] for x in (symbol, sequence, owner, rank, merged, weight))
                    if not len(symbol):
                        return out
                    starts = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
                    sizes = np.diff(np.concatenate([starts, [len(symbol)]]))
                    low = np.minimum.reduceat(rank, starts)
                chosen = self._chosen(symbol, sequence, rank, merged, np.repeat(low, sizes), starts)
                np.subtract.at(out, owner[chosen], weight[chosen] + weight[chosen + 1] - 1)
                symbol = symbol.copy()
                symbol[chosen], weight[chosen] = merged[chosen], 1
                keep = np.ones(len(symbol), bool)
                keep[chosen + 1] = False
                place = np.cumsum(keep) - 1
                symbol, sequence, owner, rank, merged, weight = (x[keep] for x in (symbol, sequence, owner, rank, merged, weight))
                changed = np.zeros(len(symbol), bool)
                changed[place[chosen]] = changed[np.maximum(place[chosen] - 1, 0)] = True
                self._renew(np.flatnonzero(changed), symbol, sequence, rank, merged)
        return out

    def _renew(self, at: np.ndarray, symbol: np.ndarray, sequence: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        follows = np.minimum(at + 1, len(symbol) - 1)
        paired = (at + 1 < len(symbol)) & (sequence[follows] == sequence[at])
        found, to = self.look(symbol[at], symbol[follows])
        rank[at], merged[at] = np.where(paired, found, _NONE), to

    def _chosen(self, symbol, sequence, rank, merged, low, starts) -> np.ndarray:
        """Positions to merge now: every place of each sequence's lowest rank, from the left and without overlap.

        Where one of these merges would make a pair of that rank or a lower one, the order of
        merging could matter, and only the sequence's leftmost place is taken.
        """
        at = np.flatnonzero(rank == low)
        breaks = np.concatenate([[True], (np.diff(at) != 1) | (sequence[at[1:]] != sequence[at[:-1]])])
        runs = np.flatnonzero(breaks)
        at = at[(np.arange(len(at)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(at)]])))) % 2 == 0]
        first = np.concatenate([[True], sequence[at[1:]] != sequence[at[:-1]]])
        if first.all():
            return at
        group = np.cumsum(first) - 1
        several = np.bincount(group)[group] > 1
        part = at[several]
        after = symbol.copy()
        after[part] = merged[part]
        risky = np.zeros(len(part), bool)
        for other in (part - 1, part + 2):  # the neighbour, which may itself be a merge
            ok = (other >= 0) & (other < len(symbol))
            ok[ok] &= sequence[other[ok]] == sequence[part[ok]]
            o, p = other[ok], part[ok]
            taken = np.zeros(len(symbol) + 1, bool)
            taken[part + 1] = True  # a swallowed symbol stands for the merge before it
            o = np.where(taken[o], o - 1, o)
            options = [after[o], symbol[o]]
            for x in options:
                r = self.look(x, after[p])[0] if other is not None and (other[ok] < p).all() else self.look(after[p], x)[0]
                risky[np.flatnonzero(ok)] |= r <= low[p]
        bad = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(bad, group[several], risky)
        return at[first | ~bad[group]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_seen: dict[tuple[str, str], int] = {}


def _pretokens(text: str, cuts: bool) -> list[str]:
    """Parts of a text; one without marks follows one mark, marks and a space are marks alone."""
    if not text:
        return []
    if not cuts:
        return [SPACE + text.replace(" ", SPACE)]
    found = text.replace(SPACE, " ").split(" ")
    if all(found):
        return found
    marks, parts = 0, []
    for part in found:
        marks += 1
        if part:
            parts.append(SPACE * marks + part if marks > 1 else part)
            marks = 0
    return [*parts, SPACE * marks + " "] if marks else parts


def count(texts: list[str], path: str) -> list[int]:
    """Tokens of each text as the model's library counts them, without begin and end marks.

    A space is put before a text, and spaces become marks; pre-tokens are runs of marks with what
    follows them. Counts of distinct pre-tokens are merged once and remembered for a while.
    """
    known = vocabulary(path)
    split = [_pretokens(t, known.cuts) for t in texts]
    seen = _seen.setdefault(path, {})
    if len(seen) > REMEMBERED:
        seen.clear()
    new = list(set().union(*split).difference(seen))
    a = 0
    while a < len(new):
        b, held = a, 0
        while b < len(new) and (b == a or held + len(new[b]) <= MERGED):
            held += len(new[b])
            b += 1
        # A part without marks stands for one mark and itself; spaces at the end are marks alone.
        full = [p[:-1] if p[-1] == " " else p if p[0] == SPACE or not known.cuts else SPACE + p for p in new[a:b]]
        seen.update(zip(new[a:b], known.count(full).tolist(), strict=True))
        a = b
    return [sum(map(seen.__getitem__, parts)) for parts in split]


def counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row's whole text.

    A narrow pass, without a shuffle. Null and empty texts have 0 bytes and 0 tokens; special
    strings are ordinary text; repeated rows are counted alike; other columns are dropped.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", 2 << 20):
            texts = batch.column("text")
            size = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            n = pa.array(count([t or "" for t in texts.to_pylist()], path), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
