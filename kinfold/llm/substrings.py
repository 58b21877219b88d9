"""Substring dedup: long runs of words that begin in an earlier document too, found in FM-indexes of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .fmindex import Index
from .jaccard import digests
from .spark import cut, small

WINDOW, GRAM = 50, 8
#: Pieces of text in a shard, and of one anchor beyond which its pieces are trimmed first.
SHARD, CROWD = 4_000, 500
#: Pieces of one class beyond which its facts are broadcast, so that no task gets them all; there are few such classes.
HOT = 10_000


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one text's windows: position of the 8-word gram, first and last window that has it as its least gram.

    Which gram of a window is the least (the first of equals) depends on the window's words alone,
    so two equal windows have one anchor at one distance.
    """
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    grams = W.windows(hashes, GRAM)
    span = WINDOW - GRAM + 1
    # Minimum over a span by doubling; ties go to the left.
    place = np.arange(len(grams))
    size = 1
    while size < span:
        shift = min(size, span - size)
        a, b = place[:-shift], place[shift:]
        place = np.where(grams[b] < grams[a], b, a)
        size += shift
    place = place[:n]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, np.append(first[1:], n) - 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text"):
        found = W.split(batch.column("text"))
        first = found.first
        grams = W.windows(found.hash, GRAM)
        held = [np.unique(grams[a + anchors(found.hash[a:b])[0]]) for a, b in zip(first, first[1:], strict=False)]
        at = np.cumsum([0, *map(len, held)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(held).view(np.int64)))
        d1, d2 = digests(found)
        sums = pa.array([hashlib.sha256(b" ".join((t or "").encode().split())).digest() for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.diff(first)), pa.array(d1), pa.array(d2), sums, lists], names=["doc_id", "key", "n_words", "d1", "d2", "sha256", "anchors"])


_PIECE = "anchor long, g1 long, g2 long, key long, doc_id long, first int, place int, words binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shared anchor of a document, the words of the windows that it is the anchor of."""
    for batch in W.slices(batches, "text", 2 << 20):
        found = W.split(batch.column("text"))
        ends = found.first
        out: list[tuple] = []
        for r, (key, doc, shared) in enumerate(zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("shared"), strict=True)):
            hashes = found.hash[ends[r] : ends[r + 1]]
            place, first, last = anchors(hashes)
            gram = W.windows(hashes, GRAM)[place].view(np.int64) if len(place) else np.zeros(0, np.int64)
            for p in np.flatnonzero(np.isin(gram, np.asarray(shared.values))).tolist():
                words = hashes[first[p] : last[p] + WINDOW].tobytes()
                mark = hashlib.blake2b(words, digest_size=16, salt=int(place[p] - first[p]).to_bytes(2, "little")).digest()
                out.append((int(gram[p]), int.from_bytes(mark[:8], "little", signed=True), int.from_bytes(mark[8:], "little", signed=True), key, doc, int(first[p]), int(place[p] - first[p]), words))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor", "g1", "g2", "key", "doc_id", "first", "place", "words"])


def _runs(at: np.ndarray) -> list[dict]:
    """Sorted positions as runs of consecutive ones."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    return [{"first": int(a), "last": int(b)} for a, b in zip(at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)], strict=True)]


_HITS = "array<struct<first:int,last:int>>"


def _every(size: Column) -> Column:
    """All windows of ``size`` bytes of word hashes, as one run."""
    return F.array(F.struct(F.lit(0).alias("first"), (F.floor(size / 8) - WINDOW).cast("int").alias("last")))


def _moved(hits: Column, by: Column) -> Column:
    return F.transform(hits, lambda x: F.struct((x["first"] + by).alias("first"), (x["last"] + by).alias("last")))


def _search(group: pd.DataFrame) -> pd.DataFrame:
    """Windows of each piece that begin in a piece of a smaller document, by the shard's FM-index."""
    sequences = [np.frombuffer(w, W.U64) for w in group["words"]]
    _, owner = np.unique(group["doc_id"].to_numpy(), return_inverse=True)
    index = Index(sequences, owner)
    found = index.statistics(owner) >= WINDOW
    hits = [_runs(np.flatnonzero(found[b : b + n])) for b, n in zip(index.begin, index.sizes, strict=True)]
    return pd.DataFrame({"anchor": group["anchor"], "g1": group["g1"], "g2": group["g2"], "hits": hits})


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = []
        for place, words in zip(batch.column("place").to_pylist(), batch.column("words").to_pylist(), strict=True):
            grams = W.windows(np.frombuffer(words, W.U64), GRAM).view(np.int64)
            lists.append([{"at": k - place, "gram": g} for k, g in enumerate(grams.tolist())])
        kind = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("anchor", "g1", "g2")), pa.array(lists, kind)], names=["anchor", "g1", "g2", "grams"])


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut pieces to the stretch around the anchor all of whose grams are found in other pieces too."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            n = len(r["words"]) // 8
            there, low, high = set(r["kept"]), 0, 0
            while low - 1 in there:
                low -= 1
            while high + 1 in there:
                high += 1
            a, b = r["place"] + low, min(r["place"] + high + GRAM, n)
            words = r["words"][8 * a : 8 * b]
            mark = hashlib.blake2b(words, digest_size=16, salt=(r["place"] - a).to_bytes(2, "little")).digest()
            if b - a >= WINDOW:
                out.append((r["anchor"], r["g1"], r["g2"], r["doc_id"], a, int.from_bytes(mark[:8], "little", signed=True), int.from_bytes(mark[8:], "little", signed=True), words))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        types = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor", "g1", "g2", "doc_id", "cut", "t1", "t2", "words"])


def _matches(pieces: DataFrame) -> DataFrame:
    """(anchor, g1, g2, hits) of distinct pieces (with doc_id, words): dealt to shards by anchor, searched in each."""
    shards = max(1, -(-pieces.count() // SHARD))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    return pieces.select("anchor", "g1", "g2", "doc_id", "words").withColumn("shard", shard).groupBy("shard").applyInPandas(_search, f"anchor long, g1 long, g2 long, hits {_HITS}")


def _in_crowds(pieces: DataFrame) -> DataFrame:
    """As :func:`_matches` for anchors with crowds of pieces, such as the edge of a passage that very many texts hold.

    Equal windows with one anchor have equal grams at equal distances from it. So a piece is cut
    to where its grams are found in another piece at that distance, counted in SQL over all pieces,
    and pieces that are equal then are one: what is left of a crowd is what its members share.
    """
    grams = pieces.mapInArrow(_grams, "anchor long, g1 long, g2 long, grams array<struct<at:int,gram:long>>").select("anchor", "g1", "g2", F.explode("grams").alias("x")).select("anchor", "g1", "g2", "x.at", "x.gram")
    often = grams.groupBy("anchor", "at", "gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "at", "gram")
    kept = grams.join(often, ["anchor", "at", "gram"]).groupBy("anchor", "g1", "g2").agg(F.collect_list("at").alias("kept"))
    trimmed = cut(pieces.join(kept, ["anchor", "g1", "g2"]).select("anchor", "g1", "g2", "doc_id", "place", "words", "kept").mapInArrow(_trim, "anchor long, g1 long, g2 long, doc_id long, cut int, t1 long, t2 long, words binary"))
    classes = cut(trimmed.groupBy("anchor", "t1", "t2").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words")))
    found = cut(_matches(classes.withColumnsRenamed({"t1": "g1", "t2": "g2"}))).withColumnsRenamed({"g1": "t1", "g2": "t2"})
    # Windows of a cut piece: all of them if a smaller document has the same, else what the index found.
    known = trimmed.join(classes.select("anchor", "t1", "t2", F.col("doc_id").alias("least")), ["anchor", "t1", "t2"]).join(found, ["anchor", "t1", "t2"])
    hits = F.when(F.col("doc_id") > F.col("least"), _every(F.octet_length("words"))).otherwise(F.col("hits"))
    return known.select("anchor", "g1", "g2", _moved(hits, F.col("cut")).alias("hits"))


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of each row; texts (doc_id, key, text) of those with shared anchors; runs of repeated windows by doc_id and key.

    In the latter two a null doc_id is the smallest number, and rows with one id and one text may be repeated.
    """
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_.alias("id"), F.xxhash64("text").alias("key"), "text")
    read = texts.drop("id").mapInArrow(_read, "doc_id long, key long, n_words long, d1 long, d2 long, sha256 binary, anchors array<long>")
    read = cut(read.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("row", F.monotonically_increasing_id()))
    copies = read.filter(F.col("n_words") >= WINDOW).groupBy("d1", "d2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    facts = read.drop("anchors").join(small(cut(copies)), ["d1", "d2"], "left").withColumn("whole", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    facts = cut(facts.select("row", "doc_id", "key", "id", "n_words", "sha256", "whole"))
    held = read.join(facts.filter("whole").select("row"), "row", "left_anti").select("id", "key", F.explode("anchors").alias("anchor"))
    shared = held.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor")
    # A set, as repeated rows bring their anchors once each.
    asked = cut(held.join(shared, "anchor").groupBy("id", "key").agg(F.collect_set("anchor").alias("shared")))
    found = texts.select("id", "key", "text").join(small(asked), ["id", "key"])
    found = cut(found.select(F.col("id").alias("doc_id"), "key", "shared", "text"))
    pieces = cut(found.mapInArrow(_pieces, _PIECE))
    classes = cut(pieces.groupBy("anchor", "g1", "g2").agg(F.min("doc_id").alias("doc_id"), F.first("place").alias("place"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n")))
    crowded = cut(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("anchor"))
    usual = _matches(classes.join(small(crowded), "anchor", "left_anti"))
    crowds = _in_crowds(classes.join(small(crowded), "anchor", "left_semi"))
    hits = usual.unionAll(crowds).filter(F.size("hits") > 0)
    # A piece that a smaller document has too is found there as a whole.
    known = classes.select("anchor", "g1", "g2", "n", F.col("doc_id").alias("least"), F.octet_length("words").alias("bytes")).join(hits, ["anchor", "g1", "g2"], "left")
    known = cut(known.filter("n > 1 OR hits IS NOT NULL"))
    places = pieces.drop("words", "place")
    hot = known.filter(F.col("n") > HOT).drop("n")
    if hot.limit(1).count():
        hot = cut(hot)
        rest = places.join(small(hot.select("anchor", "g1", "g2")), ["anchor", "g1", "g2"], "left_anti")
        named = places.join(small(hot), ["anchor", "g1", "g2"]).unionByName(rest.join(known.filter(F.col("n") <= HOT).drop("n"), ["anchor", "g1", "g2"]))
    else:
        named = places.join(known.drop("n"), ["anchor", "g1", "g2"])
    runs = F.when(F.col("doc_id") > F.col("least"), _every(F.col("bytes"))).otherwise(F.col("hits"))
    runs = named.select("doc_id", "key", F.explode(_moved(runs, F.col("first"))).alias("run")).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    return facts, found.select("doc_id", "key", "text"), runs


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_words, whole and runs of each row of ``docs``.

    ``runs`` are the windows of 50 words that also start in a document with a smaller doc_id, by
    the places of a run's first and last window; they may overlap. ``whole`` marks copies of a
    smaller document, which are repeated as a whole and have no runs. Windows are judged on the
    input. A null doc_id is smaller than any other.

    Every window has an anchor that its words determine, so equal windows meet at one anchor, and
    the index is sharded by anchors: a shard holds the pieces of text around its anchors, and only
    these are streamed through it. Anchors found in one document only are dropped before any text
    moves. Copies of a text are one text; equal pieces are one piece, of the smallest document.
    """
    facts, _, runs = _found(docs)
    runs = runs.withColumnRenamed("doc_id", "id")
    runs = facts.join(runs, ["id", "key"], "left").select("doc_id", "key", "n_words", "whole", F.when(~F.col("whole"), F.col("runs")).alias("runs"))
    return runs.withColumn("runs", F.coalesce("runs", F.array().cast(_HITS)))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, gone = [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            parts = (text or "").encode().split()
            change = np.zeros(len(parts) + 1, np.int32)
            for run in runs:
                change[run["first"]] += 1
                change[run["last"] + WINDOW] -= 1
            removed = np.cumsum(change[:-1]) > 0
            digest.append(hashlib.sha256(b" ".join([p for p, x in zip(parts, removed.tolist(), strict=True) if not x])).digest())
            gone.append(int(removed.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(gone, pa.int64()), pa.array(digest, pa.binary())], names=["id", "key", "n_removed", "kept"])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by spaces) of each row of ``docs``.

    Words that a window of :func:`repeats` covers are removed. Null and empty texts have no words;
    a text of fewer than 50 words loses none; repeated rows are judged alike and each keep their
    row; an empty table gives an empty result; other columns are dropped. Texts are read again only
    where a part of them is removed.
    """
    facts, texts, runs = _found(docs)
    parts = texts.join(runs, ["doc_id", "key"]).mapInArrow(_kept, "id long, key long, n_removed long, kept binary").dropDuplicates(["id", "key"])
    nothing = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    n = F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    digest = F.when(F.col("whole"), nothing).otherwise(F.coalesce("kept", "sha256"))
    return facts.join(parts, ["id", "key"], "left").select("doc_id", "n_words", n.cast("long").alias("n_removed"), F.lower(F.hex(digest)).alias("kept_sha256"))
