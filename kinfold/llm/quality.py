"""Quality rules: base counts of each text, and lines that too many documents of a host share."""

from __future__ import annotations

import hashlib
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .spark import cut, fresh, small

#: A line is above its host's limit if more documents hold it than this and than the square root of the host's documents.
MIN_DOCS = 10
#: A document is depleted if its lines above the limit hold more than this share of its words.
DEPLETED = 0.8

_BASE = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]


def repeat_words(hashes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(hashes) < 4:
        return 0
    triples = W.windows(hashes, 3)
    _, inverse, count = np.unique(triples, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    return int(W.cover(again, 3, len(hashes)).sum()) if len(again) else 0


#: Bytes that begin a character of a word, and those of symbols.
_CHARACTER = ((np.arange(256) & 0xC0) != 0x80) & ~W.SPACE
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _counted(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks lie in each text; summed up in small pieces, not by running totals of 8 bytes for a byte."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(marks, offsets[some], dtype=np.int64)
    return out


def base(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    found = W.split(texts)
    first = found.first
    n = np.diff(first)
    data = found.data[: found.offsets[-1]]
    chars, symbols = (_counted(marks[data], found.offsets) for marks in (_CHARACTER, _SYMBOL))
    again = np.array([repeat_words(found.hash[a:b]) for a, b in zip(first, first[1:], strict=False)], np.int64)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_repeat_words": again}


def failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _digest(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def _lines(text: str | None) -> tuple[int, list[int], list[int]]:
    """Repeated raw lines with a word; distinct normalised lines' hashes, and the words in each."""
    raw: set[bytes] = set()
    again, held = 0, {}
    for line in (text or "").encode().split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        again += line in raw
        raw.add(line)
        key = b" ".join(parts).lower()
        held[key] = held.get(key, 0) + len(parts)
    return again, [_digest(k) for k in held], list(held.values())


_FACTS = pa.schema([("key", pa.int64()), ("host", pa.string()), ("content", pa.int64()), *_BASE, ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text"):
        texts = batch.column("text")
        found = base(texts)
        again, keys, sizes = zip(*(_lines(t) for t in texts.to_pylist()), strict=True)
        found["n_dup_lines"] = again
        columns = [batch.column("key"), batch.column("host"), batch.column("content"), *(pa.array(found[n], t) for n, t in _BASE), pa.array(keys, _FACTS.field("lines").type), pa.array(sizes, _FACTS.field("line_words").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=_FACTS)


def _above(facts: DataFrame, min_docs: int) -> DataFrame:
    """The (host, line) above their limits, of rows (at, host, content, lines)."""
    once = facts.groupBy("host", "content").agg(F.min("at").alias("at"))
    limits = once.groupBy("host").agg(F.greatest(F.lit(min_docs), F.sqrt(F.count(F.lit(1)))).alias("limit"))
    counts = facts.join(once.select("at"), "at", "left_semi").select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    return cut(counts.alias("c").join(limits.alias("l"), F.expr("c.host <=> l.host AND c.n > l.limit")).select("c.host", "c.line"))


def judge(docs: DataFrame, host: str = "source", *, min_docs: int = MIN_DOCS, depleted: float = DEPLETED) -> DataFrame:
    """doc_id, host, content, the base counts, base_failed, removed_words and kept for each row of ``docs``.

    Lines are compared by a 64-bit hash of their words, A-Z in lower case. Copies
    of one text count as one document, so a text is not held against itself. A line's limit at a
    host is ``min_docs`` documents or the square root of the host's documents, whichever is larger:
    a limit in proportion to the host would spare boilerplate of large hosts. A document is depleted
    if lines above it hold more than ``depleted`` of its words.

    A line's count is aggregated before it is shuffled, and the lines above the limit are broadcast
    if they are few. Null texts have no words and fail; a null host
    is a host; repeated rows are judged alike; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").alias("key"), F.col(host).cast("string").alias("host"), F.xxhash64("text").alias("content"), "text")
    facts = cut(rows.mapInArrow(_facts, "key long, host string, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>").withColumn("at", F.monotonically_increasing_id()))
    above = _above(facts, min_docs)
    held = facts.select("at", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("at", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n"))
    removed = held.alias("h").join(small(above).alias("a"), F.expr("h.host <=> a.host AND h.line = a.line")).groupBy("at").agg(F.sum("n").alias("removed_words"))
    fails = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return facts.drop("lines", "line_words").join(removed, "at", "left").select(
        F.col("key").alias("doc_id"), "host", "content", *[n for n, _ in _BASE], fails.alias("base_failed"), F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
        (~fails & (F.coalesce("removed_words", F.lit(0)) <= depleted * F.col("n_words"))).alias("kept"),
    )


_KEYS = pa.schema([("host", pa.string()), ("content", pa.int64()), ("lines", pa.list_(pa.int64()))])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text"):
        keys = [_lines(t)[1] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("content"), pa.array(keys, _KEYS.field("lines").type)], schema=_KEYS)


def _without(text: str, gone: Container[int]) -> tuple[str, int]:
    """The text without the lines whose hashes are in ``gone``, and how many words it loses."""
    kept, lost = [], 0
    for line in text.split("\n"):
        parts = line.encode().split()
        if parts and _digest(b" ".join(parts).lower()) in gone:
            lost += len(parts)
        else:
            kept.append(line)
    return ("\n".join(kept), lost) if lost else (text, 0)


def apply(docs: DataFrame, host: str = "source", length: str | None = "n_chars", *, min_docs: int = MIN_DOCS, depleted: float = DEPLETED, held: int = 50_000) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns and without the lines above their host's limit.

    A column ``length`` gets the new number of characters of a text that loses lines. Base rules
    are held against whole texts. Up to ``held`` lines above the limit are broadcast, and the
    texts are read where they are; more are joined with the texts.
    """
    names, schema, count = docs.columns, docs.schema, length if length in docs.columns else None
    hosts, content = F.col(host).cast("string"), F.xxhash64("text")
    keys = docs.select(hosts.alias("host"), content.alias("content"), "text").mapInArrow(_keys, "host string, content long, lines array<long>")
    facts = cut(keys.withColumn("at", F.monotonically_increasing_id()))
    above = _above(facts, min_docs)
    of, keyed, lost_lines, hosted = fresh(docs, "of", "content", "gone", "host")
    rows, by_host = docs.withColumn(hosted, hosts), None
    if above.limit(held + 1).count() <= held:
        lists: dict[str | None, set[int]] = {}
        for r in above.collect():
            lists.setdefault(r["host"], set()).add(r["line"])
        by_host = docs.sparkSession.sparkContext.broadcast(lists)
    else:
        once = facts.dropDuplicates(["host", "content"]).select("host", "content", F.explode("lines").alias("line"))
        gone = once.alias("f").join(above.alias("a"), F.expr("f.host <=> a.host AND f.line = a.line")).groupBy("f.host", "f.content").agg(F.collect_list("f.line").alias(lost_lines))
        gone = gone.select(F.col("host").alias(of), F.col("content").alias(keyed), lost_lines)
        rows = rows.join(gone, F.col(hosted).eqNullSafe(F.col(of)) & (content == F.col(keyed)), "left").drop(of, keyed)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            found = base(batch.column("text"))
            ok = ~failed(found["n_words"], found["n_repeat_words"])
            batch, n_words = batch.filter(pa.array(ok)), found["n_words"][ok]
            if by_host is None:
                gone = batch.column(lost_lines).to_pylist()
            else:
                gone = [by_host.value.get(h) for h in batch.column(hosted).to_pylist()]
            old = batch.column("text").to_pylist()
            new = [_without(t, g) if g else (t, 0) for t, g in zip(old, gone, strict=True)]
            out = []
            for name in names:
                column = batch.column(name)
                if name == "text":
                    column = pa.array([t for t, _ in new], column.type)
                elif name == count:
                    column = pa.array([len(t) if lost else was for was, (t, lost) in zip(column.to_pylist(), new, strict=True)], column.type)
                out.append(column)
            stay = [lost <= depleted * int(n) for (_, lost), n in zip(new, n_words, strict=True)]
            yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(stay, pa.bool_()))

    return rows.mapInArrow(cleaned, schema)
