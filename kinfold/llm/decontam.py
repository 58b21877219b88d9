"""Benchmark decontamination on a positional inverted index that is dealt out by documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .spark import cut, without

#: Bytes of text in a segment of the index, and of test items that are searched for at once.
SEGMENT_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
WINDOW = 10

_INDEX = pa.schema([("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])


def _tokens(texts: pa.Array) -> W.Words:
    return W.split(texts, W.SEPARATES, W.FOLD)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text", SEGMENT_BYTES):
        found = _tokens(batch.column("text"))
        bits = W.U64(max(len(found.hash), 1).bit_length())
        # Sorting (term, place) as one number: the term's upper bits are what the place leaves free.
        postings = np.sort((found.hash >> bits << bits) | np.arange(len(found.hash), dtype=W.U64))
        terms = postings >> bits
        first = np.flatnonzero(np.concatenate([np.ones(min(len(terms), 1), bool), terms[1:] != terms[:-1]]))
        counts = np.diff(np.concatenate([first, [len(terms)]])).astype(np.uint32)
        places = (postings & ((W.U64(1) << bits) - W.U64(1))).astype(np.uint32)
        row = [batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), np.diff(found.first).tolist(), terms[first].tobytes(), counts.tobytes(), places.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _INDEX, strict=True)], schema=_INDEX)


def index(docs: DataFrame) -> DataFrame:
    """A stored positional index of ``docs`` (doc_id, text): a row for each segment of a few thousand documents.

    A segment holds its documents' ids, text hashes and lengths, and its postings: terms in order
    (the upper bits of a 64-bit word hash), how many places each has, and the places, counted over
    the segment. Nothing is shuffled: a phrase lies in one document, so a segment answers for its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    built = rows.mapInArrow(_build, "docs array<long>, keys array<long>, sizes array<long>, terms binary, counts binary, places binary")
    return cut(built.withColumn("segment", F.monotonically_increasing_id()))


class _Segment:
    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        terms, counts = np.frombuffer(row["terms"], W.U64), np.frombuffer(row["counts"], np.uint32)
        places = np.frombuffer(row["places"], np.uint32)
        self.bits = W.U64(max(len(places), 1).bit_length())
        self.terms, self.counts = terms, counts
        self.starts = np.cumsum(counts, dtype=np.int64) - counts
        self.postings = (np.repeat(terms, counts) << self.bits) | places
        self.places = places.astype(np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Index of each term hash in this segment, -1 if it isn't there."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        short = terms >> self.bits
        at = np.minimum(np.searchsorted(self.terms, short), len(self.terms) - 1)
        return np.where(self.terms[at] == short, at, -1)

    def near(self, term: np.ndarray, place: np.ndarray, forward: bool) -> np.ndarray:
        """The next place of each term from ``place`` on, or the last one up to it; far off if there is none."""
        key = (self.terms[term] << self.bits) | np.maximum(place, 0).astype(W.U64)
        at = np.searchsorted(self.postings, key) if forward else np.searchsorted(self.postings, key, "right") - 1
        inside = (at >= self.starts[term]) & (at < self.starts[term] + self.counts[term]) & (place >= 0)
        return np.where(inside, self.places[np.clip(at, 0, len(self.places) - 1)], -(1 << 40))

    def search(self, phrases: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which phrase occurs from which place to which, for phrases (a row of term hashes each).

        The rarest term's places are the anchors; the other terms' lists, nearest offsets first, are
        intersected with them in phrase order. All terms must lie within ``slop`` places more than
        the phrase has terms; with a slop of 0 the phrase is matched exactly.
        """
        unique, where = np.unique(phrases, return_inverse=True)
        term = self.find(unique)[where.reshape(phrases.shape)]
        which = np.flatnonzero((term >= 0).all(axis=1)) if phrases.shape[1] else np.zeros(0, int)
        term, size = term[which], phrases.shape[1]
        if not len(which):
            return which, which, which
        rarest = self.counts[term].argmin(axis=1)
        anchor = term[np.arange(len(which)), rarest]
        n = self.counts[anchor].astype(np.int64)
        phrase = np.repeat(np.arange(len(which)), n)
        place = self.places[np.repeat(self.starts[anchor], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        first, last, k = place, place, rarest[phrase]
        for step in range(1, size):
            for forward in (True, False):
                t = k + step if forward else k - step
                go = np.flatnonzero((t < size) & (t >= 0))
                if not len(go):
                    continue
                edge = last if forward else first
                at = self.near(term[phrase[go], t[go]], edge[go] + (1 if forward else -1), forward)
                edge = edge.copy()
                edge[go] = at
                first, last = (first, edge) if forward else (edge, last)
                ok = (first >= 0) & (last >= 0) & (last - first < size + slop)
                phrase, first, last, k = phrase[ok], first[ok], last[ok], k[ok]
        doc = np.searchsorted(self.begin, first, "right") - 1
        ok = last < self.begin[doc] + self.sizes[doc]
        return which[phrase[ok]], first[ok], last[ok]


def _phrases(texts: list[str], size: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct windows (rows of term hashes) by length, each with the item it is of."""
    found = _tokens(pa.array(texts, pa.string()))
    by: dict[int, list] = {}
    for item, (a, b) in enumerate(zip(found.first, found.first[1:], strict=False)):
        if b > a:
            n = min(size, int(b - a))
            rows = np.lib.stride_tricks.sliding_window_view(found.hash[a:b], n)
            by.setdefault(n, []).append((rows, np.full(len(rows), item)))
    return {n: (np.concatenate([r for r, _ in x]), np.concatenate([i for _, i in x])) for n, x in by.items()}


_HITS = pa.schema([("segment", pa.int64()), ("place", pa.int64()), ("item_id", pa.int64()), ("first", pa.int64()), ("past", pa.int64())])


def _searcher(items: Broadcast, size: int, slop: int) -> Callable:
    """Searches segments for ``items``, a pair of ids and texts."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = items.value
        phrases, ids = _phrases(texts, size), pa.array(ids, pa.int64())
        for batch in batches:
            for row in batch.to_pylist():
                held = _Segment(row)
                for rows, of in phrases.values():
                    which, first, last = held.search(rows, slop)
                    doc = np.searchsorted(held.begin, first, "right") - 1
                    columns = [pa.array(np.full(len(doc), row["segment"])), pa.array(doc), ids.take(pa.array(of[which])), pa.array(first - held.begin[doc]), pa.array(last - held.begin[doc] + 1)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_HITS)

    return searched


def search(built: DataFrame, items: DataFrame, *, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """Occurrences of test items in an :func:`index`: segment, place (of the document in it), item_id, first, past.

    A window is ``size`` consecutive words of an item (all of them if it has fewer); an occurrence
    covers words ``first`` to ``past`` - 1 of its document. With ``slop`` the words may stand that
    much further apart. The items are the query set, which each segment answers in one pass for
    ``BLOCK_BYTES`` of their texts: a block is dealt by hash and sent to the tasks once, so that
    what a task or the driver holds doesn't grow with the number of items.
    """
    asked = cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text <> ''"))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    found = []
    for k in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        block = items.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))
        found.append(built.mapInArrow(_searcher(block, size, slop), "segment long, place long, item_id long, first long, past long"))
    return reduce(DataFrame.unionAll, found)


def judge(docs: DataFrame, items: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """doc_id, key (hash of the text), n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``docs``.

    A word is hit if it lies in an occurrence of a window of an item. Null or empty texts and items
    have no words; an item without an id hits words but is no part of n_items; repeated rows are
    judged one by one; without items nothing is contaminated. Other columns are dropped.
    """
    built = index(docs)
    hits = cut(search(built, items, size=size))
    # Words covered: each occurrence adds what lies beyond all that began before it.
    order = Window.partitionBy("segment", "place").orderBy("first", "past").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("segment", "place", "first", "past").distinct().withColumn("reached", F.coalesce(F.max("past").over(order), F.lit(0)))
    words = spans.groupBy("segment", "place").agg(F.sum(F.greatest(F.lit(0), F.col("past") - F.greatest("first", "reached"))).alias("n_hit"))
    named = hits.groupBy("segment", "place").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = built.select("segment", F.posexplode(F.arrays_zip("docs", "keys", "sizes")).alias("place", "x")).select("segment", F.col("place").cast("long").alias("place"), F.col("x.docs").alias("doc_id"), F.col("x.keys").alias("key"), F.col("x.sizes").alias("n_words"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(words.join(named, ["segment", "place"]), ["segment", "place"], "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep(docs: DataFrame, items: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    gone = judge(docs, items, size=size).filter("contaminated")
    return without(docs, gone, doc_id=F.col("doc_id").cast("long"), key=F.xxhash64("text"))
