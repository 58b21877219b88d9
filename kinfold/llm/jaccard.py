"""N-gram Jaccard join: MinHash candidates, pruned by a posterior probability, verified exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .components import components
from .spark import cut, small, without

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of rows: documents with a similarity of 0.8 share no band once in 350,000 times.
BANDS, ROWS = 42, 6
#: MinHash values compared at a time; probability under which a pair is dropped.
STEP, TOLERANCE = 28, 1e-9
#: Words of the texts in a block of a cluster; a task compares two blocks.
BLOCK_WORDS = 400_000
#: Clusters of more blocks than this are split by bands of more rows: at 0.8 all of them miss a pair as rarely as those
#: above, but documents with a similarity of 0.4 share one once in 80 times, not in 6.
SPLIT_BLOCKS, FINE_BANDS, FINE_ROWS = 4, 112, 10

_A, _FINE = (np.array([(x | 1) for x in np.random.default_rng(seed).integers(0, 1 << 63, n, np.int64)], W.U64) for seed, n in ((20240607, BANDS * ROWS), (20240608, FINE_BANDS * FINE_ROWS)))


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of one text's words, sorted; a shorter text is one shingle."""
    return np.unique(W.windows(hashes, min(size, max(len(hashes), 1)))) if len(hashes) else np.zeros(0, W.U64)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (upper 32 bits) of each set."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([(np.minimum.reduceat(flat * a, at) >> W.U64(32)).astype(np.uint32) for a in _A], axis=1)


@lru_cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest of ``n`` equal MinHash values with which a pair may still reach the threshold.

    With a uniform prior the similarity given m of n matches is Beta(m + 1, n - m + 1), whose upper
    tail is the chance of at most m heads in n + 1 throws with the threshold's probability.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of ``left`` and ``right`` have the Jaccard similarity; pairs i < j of ``left`` if right is None."""
    other = left if right is None else right
    a, b = signature(left), signature(other) if right is not None else None
    b = a if b is None else b
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in other])
    fits = np.minimum(na[:, None], nb[None]) >= threshold * np.maximum(na[:, None], nb[None])
    i, j = np.nonzero(np.triu(fits, 1) if right is None else fits)
    matches = np.zeros(len(i), np.int32)
    for k in range(0, a.shape[1], STEP):
        for p in range(0, len(i), 1 << 16):
            part = slice(p, p + (1 << 16))
            matches[part] += (a[i[part], k : k + STEP] == b[j[part], k : k + STEP]).sum(axis=1, dtype=np.int32)
        alive = matches >= least_matches(min(k + STEP, a.shape[1]), threshold, tolerance)
        i, j, matches = i[alive], j[alive], matches[alive]
    if not len(i):
        return i, j
    if len(i) <= 32:
        both = np.array([len(np.intersect1d(left[x], other[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:
        both = _shared(left, other, i, j)
    ok = both / (na[i] + nb[j] - both) >= threshold
    return i[ok], j[ok]


def _shared(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections, by products of the sets' incidence matrices over some shingles at a time."""
    use_l, use_r = np.unique(i), np.unique(j)
    flat = np.concatenate([*(left[x] for x in use_l), *(right[x] for x in use_r)])
    row = np.repeat(np.arange(len(use_l) + len(use_r)), [*(len(left[x]) for x in use_l), *(len(right[x]) for x in use_r)])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(use_l), len(use_r)), np.float32)
    width = 4096
    for k in range(0, int(often.sum()), width):
        x, y = np.searchsorted(column, [k, k + width])
        dense = np.zeros((len(use_l) + len(use_r), width), np.float32)
        dense[row[x:y], column[x:y] - k] = 1
        total += dense[: len(use_l)] @ dense[len(use_l) :].T
    return total[np.searchsorted(use_l, i), np.searchsorted(use_r, j)].astype(np.int64)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def digests(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words."""
    first = found.first
    place = (np.arange(len(found.hash)) - first[found.row]).astype(W.U64)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, W.U64), np.cumsum(W.mix(found.hash ^ W.mix(place * W.U64(salt) + W.U64(salt))))])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def bands(found: W.Words, factors: np.ndarray, rows: int) -> pa.ListArray:
    """The MinHash bands, of ``rows`` values each, of every text that has a shingle."""
    first = found.first
    n = np.diff(first)
    grams = W.windows(found.hash, SHINGLE)
    long = np.flatnonzero(n >= SHINGLE)
    keys = np.zeros((len(long), len(factors) // rows), W.U64)
    if len(long):
        at = np.stack([first[long], first[long] + n[long] - SHINGLE + 1], axis=1).ravel()  # reduceat takes every other run
        padded = np.concatenate([grams, grams[-1:]])
        for band in range(keys.shape[1]):
            key = np.full(len(long), band + 1, W.U64)
            for a in factors[band * rows : (band + 1) * rows]:
                key = W.mix(key ^ (np.minimum.reduceat(padded * a, at)[::2] >> W.U64(32)))
            keys[:, band] = key
    sizes = np.zeros(len(n), np.int64)
    sizes[long] = keys.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("row"), bands(W.split(batch.column("text")), _FINE, FINE_ROWS)], names=["row", "bands"])


def _clusters(banded: DataFrame) -> DataFrame:
    """(node, root) of the rows that a chain of shared bands joins, of rows (row, band)."""
    shared = banded.groupBy("band").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "least")
    return cut(components(banded.join(shared, "band").select(F.col("row").alias("a"), F.col("least").alias("b"))))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text"):
        found = W.split(batch.column("text"))
        first = found.first
        n = np.diff(first)
        d1, d2 = digests(found)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n), pa.array(d1), pa.array(d2), bands(found, _A, ROWS)], schema=_PROFILE)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text"):
        found = W.split(batch.column("text"))
        sets = [shingles(found.hash[a:b]).tobytes() for a, b in zip(found.first, found.first[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "cluster", "n", "weight")), pa.array(sets, pa.binary())], names=["row", "cluster", "n", "weight", "set"])


def _compare(threshold: float, tolerance: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def compared(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("row").sort_values(["block", "row"])
        rows, weight = group["row"].to_numpy(), group["weight"].to_numpy()
        sets = [np.frombuffer(x, W.U64) for x in group["set"]]
        low, high = group["low"].iloc[0], group["high"].iloc[0]
        if low == high:
            i, j = pairs(sets, None, threshold, tolerance)
        else:
            n = int((group["block"] == low).sum())
            i, j = pairs(sets[:n], sets[n:], threshold, tolerance) if 0 < n < len(sets) else (np.zeros(0, int), np.zeros(0, int))
            j = j + n
        links = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
        peer = np.arange(len(rows))
        while len(i):
            before = peer.copy()
            np.minimum.at(peer, i, peer[j])
            np.minimum.at(peer, j, peer[i])
            peer = peer[peer]
            if (peer == before).all():
                break
        return pd.DataFrame({"row": rows, "links": links.astype(np.int64), "peer": rows[peer]})

    return compared


def classes(docs: DataFrame, *, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, key (hash of the text), row, n_words, class_id, n_links and stays of each row of ``docs``.

    Documents are linked if the sets of their 5-word shingles have a Jaccard similarity of at least
    ``threshold``; n_links counts a row's links, class_id is the least doc_id of those that links
    join, and stays marks one row of each class, the one with the least doc_id.

    Texts with the same words are one representative with a weight. Representatives that share a
    MinHash band form clusters, found by components over (row, least row of the band); a large
    cluster, which chains of unlike documents may have joined, is split by stricter bands. A task gets
    two blocks of a cluster, compares the MinHash values of their pairs step by step, drops pairs
    whose posterior probability of reaching the threshold is below ``tolerance``, verifies the rest
    exactly, and returns each row's number of links and its least linked row: never the pairs.

    A text of one to four words is one shingle and is linked to its copies only; a null or empty
    text is a class of its own without links; repeated rows are copies; a null doc_id has a class
    like any other, named by the least id that isn't null. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    profile = cut(texts.mapInArrow(_profile, "doc_id long, key long, n_words long, d1 long, d2 long, bands array<long>").withColumn("row", F.monotonically_increasing_id()))
    copies = cut(profile.filter("n_words > 0").groupBy("d1", "d2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("weight")))
    facts = profile.select("row", "doc_id", "key", "n_words")

    def read(wanted: DataFrame, *columns: str) -> DataFrame:
        """``columns`` and text of the rows wanted (with doc_id, key)."""
        found = texts.alias("t").join(small(wanted).alias("w"), F.expr("t.doc_id <=> w.doc_id AND t.key = w.key"))
        # Of rows with one id and one text only one is wanted, but all of them are found.
        return found.select(*[f"w.{c}" for c in columns], "t.text")

    def sized(clusters: DataFrame) -> DataFrame:
        """(row, cluster, n: its number of blocks, doc_id, key)"""
        member = cut(clusters.select(F.col("node").alias("row"), F.col("root").alias("cluster")).join(facts, "row"))
        size = member.groupBy("cluster").agg(F.ceil(F.sum("n_words") / BLOCK_WORDS).cast("int").alias("n"))
        return cut(member.join(small(cut(size)), "cluster").select("row", "cluster", "n", "doc_id", "key"))

    member = sized(_clusters(profile.join(copies.select("row"), "row", "left_semi").select("row", F.explode("bands").alias("band"))))
    large = member.filter(F.col("n") > SPLIT_BLOCKS)
    if large.limit(1).count():
        fine = cut(read(cut(large), "row").mapInArrow(_fine, "row long, bands array<long>"))
        fine = sized(_clusters(fine.select("row", F.explode("bands").alias("band")).distinct()))
        member = member.filter(F.col("n") <= SPLIT_BLOCKS).unionAll(fine)
    wanted = cut(member.join(copies.select("row", "weight"), "row"))
    sets = read(wanted, "row", "cluster", "n", "weight").mapInArrow(_sets, "row long, cluster long, n int, weight long, set binary")
    block = F.pmod(F.xxhash64("row"), F.col("n")).cast("int")
    dealt = sets.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
    compared = cut(dealt.groupBy("cluster", "low", "high").applyInPandas(_compare(threshold, tolerance), "row long, links long, peer long"))
    links = compared.groupBy("row").agg(F.sum("links").alias("links")).filter("links > 0")
    roots = components(compared.filter("row <> peer").select(F.col("row").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "row")
    linked = cut(links.join(roots, "row", "left"))
    # Only rows with copies or links need be told of them.
    known = copies.join(small(linked), "row", "left").filter("weight > 1 OR links IS NOT NULL")
    known = cut(known.select("d1", "d2", F.coalesce("root", "row").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    rows = cut(profile.drop("bands").join(small(known), ["d1", "d2"], "left").drop("d1", "d2"))
    # The least id of a class, then the least row with it: two sums of fixed size rather than a struct's minimum.
    joined = rows.filter("root IS NOT NULL").select("row", "doc_id", "root")
    least = cut(joined.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    first = joined.join(small(least), "root").filter("doc_id <=> class_id").groupBy("root").agg(F.min("row").alias("first"))
    named = cut(least.join(first, "root"))
    alone = F.col("root").isNull()
    return rows.join(small(named), "root", "left").select(
        "doc_id", "key", "row", "n_words", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("row") == F.col("first"))).alias("stays"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay in :func:`classes`, one of each class, with all their columns.

    Rows with one id and one text are alike; of them one is kept.
    """
    judged = cut(classes(docs))
    names = ["doc_id", "key"]
    per = cut(judged.groupBy(*names).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")))
    one = without(docs, per.filter("NOT stays"), doc_id=F.col("doc_id").cast("long"), key=F.xxhash64("text"))
    return one.dropDuplicates(["doc_id", "text"]) if per.filter("n > 1").limit(1).count() else one
