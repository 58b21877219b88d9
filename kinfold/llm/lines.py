"""Line dedup: an exact set-similarity join of lines with prefix, length, position and bitmap filters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import words as W
from .spark import cut, fresh, small, unwritten, written

THRESHOLD = 0.8
#: Token counts are kept in this many counters, whatever the vocabulary; tokens that share one only seem less rare.
COUNTERS, CHUNKS = 1 << 20, 16
#: A token is 44 bits of its hash, so that (line, token) is one number in batches of up to a million lines.
_BITS = W.U64(44)
_TOKEN = (W.U64(1) << _BITS) - W.U64(1)
#: Lines and the words of their prefixes go to parts as blocks, a row for what a task has for a part; it deals lines with
#: so many words in prefixes at a time.
DEALT = 1 << 19
#: Words of whole texts, repeats counted, for which there is a part at least; some tenth of them are in prefixes.
PART_WORDS = 1 << 24
#: Pairs of lines that are looked at in one go, unless one line has more.
PAIRS = 1 << 20
#: So many lines tested against one earlier line are a crowd. This many of its lines that are nearest to the earlier one, and
#: as many of its first ones, are hubs; a line meets as many of them for each word of its prefix before it meets all lines.
CROWD, HUBS = 16, 4
#: 64-bit words of the bitmap that a crowd's lines have besides the one of all lines.
WIDE = 8
#: The columns of the 256-bit bitmap that all lines have, against which pairs are held before their sets are fetched.
SIGNS = ["w0", "w1", "w2", "w3"]
#: The bit of a place in a prefix, above the place, of lines that have such a bitmap.
CROWDED = np.uint32(1 << 31)


def _used(found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lines begin, the indexes of those that have words, and how many words each of these has."""
    begins = np.unique(np.concatenate([found.offsets[:-1], np.flatnonzero(found.data[: int(found.offsets[-1])] == 10) + 1]))
    words = np.diff(np.searchsorted(found.start, begins), append=len(found.start))
    used = np.flatnonzero(words)
    return begins, used, words[used]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (line, token) in order: line's index, token; and for each line that has words its text and number in it."""
    found = W.split(texts)
    begins, used, words = _used(found)
    index = np.repeat(np.arange(len(used)), words)
    token = found.hash >> W.U64(20)
    if len(used) < 1 << 20:
        packed = (index.astype(W.U64) << _BITS) | token
        packed.sort()
        index, token = (packed >> _BITS).astype(np.int64), packed & _TOKEN
    else:
        order = np.lexsort((token, index))
        index, token = index[order], token[order]
    new = np.append(True, (index[1:] != index[:-1]) | (token[1:] != token[:-1]))[: len(index)]
    index, token = index[new], token[new]
    row = np.searchsorted(found.offsets, begins[used], "right") - 1
    return index, token, row, used - np.searchsorted(begins, found.offsets[row])


_COUNTED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_lines", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the number of lines for each text, and rows with the task's counters."""
    total, held, n_held = np.zeros(COUNTERS, np.int64), [], 0
    for batch in W.slices(batches, "text", 1 << 19):
        found = W.split(batch.column("text"))
        held.append((found.hash >> W.U64(20) & W.U64(COUNTERS - 1)).view(np.int64))
        n_held += len(held[-1])
        if n_held >= COUNTERS:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
            held, n_held = [], 0
        begins, used, _ = _used(found)
        n = np.bincount(np.searchsorted(found.offsets, begins[used], "right") - 1, minlength=len(batch))
        none = [pa.nulls(len(batch), _COUNTED.field(k).type) for k in (3, 4)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n.astype(np.int64)), *none], schema=_COUNTED)
    if n_held:
        total += np.bincount(np.concatenate(held), minlength=COUNTERS)
    parts = [(k, _packed(x)) for k, x in enumerate(np.split(total, CHUNKS)) if x.any()]
    none = [pa.nulls(len(parts), pa.int64())] * 3
    yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], schema=_COUNTED)


def _packed(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest needs."""
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max())).tobytes(), 1)


def _unpacked(counts: bytes) -> np.ndarray:
    raw = zlib.decompress(counts)
    return np.frombuffer(raw, f"<u{len(raw) // (COUNTERS // CHUNKS)}")


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // CHUNKS, np.int64)
    for x in group["counts"]:
        total += _unpacked(x).astype(np.int64)
    return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "counts": [_packed(total)]})


def counted(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, key and n_lines of each row, and the occurrences of the tokens of each counter, in one pass over the texts.

    The counters are summed up in two levels, 8 MB whatever the input.
    """
    found = texts.mapInArrow(_count, "doc_id long, key long, n_lines long, chunk int, counts binary")
    found = cut(found.withColumn("task", F.spark_partition_id()))
    parts = found.filter("chunk IS NOT NULL")
    level = F.pmod(F.col("task"), F.lit(max(1, isqrt(parts.rdd.getNumPartitions()))))
    some = parts.groupBy("chunk", level.alias("level")).applyInPandas(_add, "chunk int, counts binary")
    out = np.zeros(COUNTERS, np.uint64)
    for row in some.groupBy("chunk").applyInPandas(_add, "chunk int, counts binary").collect():
        out[row["chunk"] * (COUNTERS // CHUNKS) :][: COUNTERS // CHUNKS] = _unpacked(row["counts"])
    return found.filter("chunk IS NULL").select("doc_id", "key", "n_lines"), out


def ranks(counts: np.ndarray) -> np.ndarray:
    """12 bits for each counter that grow with it: the leading bits of its floating-point form."""
    return ((counts.astype(np.float32) + np.float32(1)).view(np.uint32) - np.uint32(0x3F800000) >> np.uint32(17)).astype(np.uint16)


_LINE = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("line", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("bitmap", pa.int64()), *((w, pa.int64()) for w in SIGNS), ("prefix", pa.list_(pa.int32()))])


def _prefixes(rarities, threshold: float):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = rarities.value
        for batch in W.slices(batches, "text", 1 << 19):
            index, token, row, number = _tokens(batch.column("text"))
            if not len(row):
                continue
            start = np.searchsorted(index, np.arange(len(row)))
            n = np.diff(np.append(start, len(index)))
            s1, s2 = (np.add.reduceat(W.mix(token ^ W.U64(salt)), start).view(np.int64) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
            bitmap = np.bitwise_xor.reduceat(W.U64(1) << (token >> W.U64(30) & W.U64(63)), start).view(np.int64)
            bit, which = W.U64(1) << (token & W.U64(63)), token >> W.U64(6) & W.U64(len(SIGNS) - 1)
            signs = [pa.array(np.bitwise_xor.reduceat(np.where(which == W.U64(k), bit, W.U64(0)), start).view(np.int64)) for k in range(len(SIGNS))]
            # Rarest first; equal ranks in the order of the tokens' upper 32 bits, which stand for them in prefixes.
            rarity, word = held[(token & W.U64(COUNTERS - 1)).astype(np.int64)].astype(W.U64), token >> W.U64(12)
            if len(row) < 1 << 20:
                word = (index.astype(W.U64) << W.U64(44)) | (rarity << W.U64(32)) | word
                word.sort()
            else:
                word = word[np.lexsort((word, rarity, index))]
            size = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            place = np.arange(len(index)) - np.repeat(start, n)
            first = word[place < np.repeat(size, n)] & W.U64(0xFFFFFFFF)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(first.astype(np.uint32).view(np.int32)))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(number), pa.array(s1), pa.array(s2), pa.array(n), pa.array(bitmap), *signs, prefix], schema=_LINE)

    return made


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token sets of the lines asked for, and their wide bitmaps: columns text, lines (list of number and id)."""
    for batch in W.slices(batches, "text", 2 << 20):
        ids, found = [], []
        for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            of_text = text.split("\n")
            ids += [x["id"] for x in asked]
            found += [of_text[x["line"]] for x in asked]
        index, token, _, _ = _tokens(pa.array(found, pa.large_string()))
        start = np.searchsorted(index, np.arange(len(ids) + 1)).astype(np.int32)
        wide = np.zeros((len(ids), WIDE), W.U64)
        np.bitwise_xor.at(wide, (index, (token >> W.U64(6) & W.U64(WIDE - 1)).astype(np.int64)), W.U64(1) << (token & W.U64(63)))
        words = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * np.int32(WIDE)), pa.array(wide.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(start), pa.array(token.astype(np.int64))), words], names=["id", "tokens", "wide"])


def _fits(a: str, b: str, threshold: float) -> Column:
    """Length, position and bitmap filters: a pair of that similarity passes at its first common prefix token."""
    n, m = (F.shiftright(F.col(f"{x}.packed"), 32) for x in (a, b))
    after_a, after_b = (size - F.col(f"{x}.packed").bitwiseAND(F.lit((1 << 32) - 1)) for size, x in ((n, a), (m, b)))
    overlap = F.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    return (
        (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9)
        & (F.least(after_a, after_b) >= overlap)
        & (F.bit_count(F.col(f"{a}.bitmap").bitwiseXOR(F.col(f"{b}.bitmap"))) <= n + m - 2 * overlap)
    )


_WORD = {"word": np.dtype("<u4"), "id": np.dtype("<i8"), "n": np.dtype("<i4"), "place": np.dtype("<u4"), "bitmap": np.dtype("<u8"), "wide": np.dtype(("<u8", WIDE))}
_SET = {"known": np.dtype("?"), **{x: np.dtype("<i8") for x in ("doc_id", "key", "s1", "s2", "bitmap", *SIGNS)}, **{x: np.dtype("<i4") for x in ("line", "n", "size", "prefix")}}


def _typed(kinds: dict[str, np.dtype]) -> str:
    return "part int, " + ", ".join(f"{name} binary" for name in kinds)


def _block(part: np.ndarray, values: dict[str, np.ndarray | pa.ListArray], kinds: dict[str, np.dtype]) -> pa.RecordBatch:
    """A row for each part with what it gets, the values of a column in one run of bytes."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    used, first = np.unique(part[order], return_index=True)
    first = np.append(first, len(part))
    columns = [pa.array(used.astype(np.int32))]
    for name, kind in kinds.items():
        begin, data = first, values[name]
        if isinstance(data, pa.ListArray):
            taken = data.take(pa.array(order))
            begin, data = np.asarray(taken.offsets)[first].astype(np.int64) * kind.base.itemsize, np.asarray(taken.flatten())
        else:
            begin, data = first * kind.itemsize, data[order].astype(kind, copy=False)
        columns.append(pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data.tobytes())]))
    return pa.RecordBatch.from_arrays(columns, names=["part", *kinds])


def _dealt(batches: Iterator[pa.RecordBatch], block: Callable[[dict[str, pa.Array]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of lines, made of as many lines as have about ``DEALT`` words in their prefixes."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lines = pa.Table.from_batches(held)
        return block({name: pa.concat_arrays(lines.column(name).chunks) for name in lines.schema.names})

    held, words = [], 0
    for batch in batches:
        size = np.asarray(batch.column("prefix").value_lengths(), np.int64)
        group = np.cumsum(size) // DEALT
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            held.append(batch.slice(a, b - a))
            words += int(size[a:b].sum())
            if words >= DEALT:
                yield made(held)
                held, words = [], 0
    if held:
        yield made(held)


def _gathered(batches: Iterator[pa.RecordBatch], kinds: dict[str, np.dtype]) -> tuple[int, dict[str, np.ndarray]]:
    """The number of a part and all that it has got, by column."""
    part, held = 0, {name: [np.zeros(0, kind)] for name, kind in kinds.items()}
    for batch in batches:
        if not len(batch):
            continue
        part = batch.column("part")[0].as_py()
        for name, kind in kinds.items():
            column = batch.column(name).cast(pa.large_binary())
            _, at, data = column.buffers()
            at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
            if at[-1] > at[0]:
                held[name].append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind.base).reshape(-1, *kind.shape))
    return part, {name: np.concatenate(x) for name, x in held.items()}


def _lines_dealt(rarities, threshold: float, parts: int):
    """Deals lines to ``parts`` by their word sets."""
    prefixes = _prefixes(rarities, threshold)

    def block(lines: dict[str, pa.Array]) -> pa.RecordBatch:
        values = {name: lines[name] if name == "prefix" else np.asarray(lines[name].fill_null(0)) for name in _LINE.names}
        values |= {"known": np.asarray(lines["doc_id"].is_valid()), "size": np.asarray(lines["prefix"].value_lengths())}
        return _block(values["s1"].view(W.U64) % W.U64(parts), values, _SET)

    return lambda batches: _dealt(prefixes(batches), block)


def _ragged(x: dict[str, np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(x["size"], dtype=np.int64)).astype(np.int32)), pa.array(x["prefix"]))


def _firsts_dealt(bounds):
    """The earliest line of each word set, dealt by the ranges between ``bounds`` (known, doc_id, key)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x = _gathered(batches, _SET)
        order = np.lexsort([x[c] for c in ("line", "key", "doc_id", "known", "s2", "s1")])
        s1, s2 = x["s1"][order], x["s2"][order]
        order = order[np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))[: len(order)]]
        if not len(order):
            return
        values = {c: x[c][order] for c in _SET if c != "prefix"} | {"prefix": _ragged(x).take(pa.array(order))}
        limits, n = bounds.value, len(bounds.value["key"])
        # A limit comes before the lines that equal it, so that lines of one text are in one range.
        ranked = np.lexsort([np.concatenate([limits[c], values[c]]) for c in ("key", "doc_id", "known")])
        part = np.zeros(n + len(order), np.int64)
        part[ranked] = np.cumsum(ranked < n)
        yield _block(part[n:], values, _SET)

    return made


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a range with ids, of which one is less than another if its line is earlier."""
    part, x = _gathered(batches, _SET)
    order = np.lexsort([x[c] for c in ("line", "key", "doc_id", "known")])
    prefixes = _ragged(x)
    for a in range(0, len(order), 1 << 14):
        at = order[a : a + (1 << 14)]
        columns = [pa.array((part << 33) + a + np.arange(len(at)), pa.int64()), pa.array(x["doc_id"][at], mask=~x["known"][at])]
        columns += [pa.array(x[c][at]) for c in list(_FIRST)[2:-1]]
        yield pa.RecordBatch.from_arrays([*columns, prefixes.take(pa.array(at))], names=list(_FIRST))


_FIRST = {"id": "long", "doc_id": "long", "key": "long", "line": "int", "n": "int", "bitmap": "long", **dict.fromkeys(SIGNS, "long"), "prefix": "array<int>"}


def limits_of(texts: DataFrame, parts: int) -> dict[str, np.ndarray]:
    """Where ranges of texts (doc_id, key, n_lines) in order begin that have about as many lines each, by some 64 texts for each range."""
    texts = texts.filter("n_lines > 0")
    one_in = max(1, texts.count() // (64 * parts))
    some = texts.filter(F.pmod(F.xxhash64("doc_id", "key"), F.lit(one_in)) == 0).toArrow()
    values = {"known": np.asarray(some["doc_id"].is_valid()), "doc_id": np.asarray(some["doc_id"].fill_null(0)), "key": np.asarray(some["key"])}
    order = np.lexsort([values[c] for c in ("key", "doc_id", "known")])
    total = np.cumsum(np.asarray(some["n_lines"])[order])
    at = order[np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)] if len(order) else order
    return {c: x[at] for c, x in values.items()}


def _words_dealt(parts: int):
    """Deals the words of lines' prefixes (columns id, n, bitmap, prefix and perhaps wide) to ``parts``."""

    def block(lines: dict[str, pa.Array]) -> pa.RecordBatch:
        size = np.asarray(lines["prefix"].value_lengths(), np.int64)
        word = np.asarray(lines["prefix"].flatten()).view(np.uint32)
        index = np.repeat(np.arange(len(size)), size)
        place = (np.arange(len(index)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint32)
        values = {"word": word, "place": place} | {c: np.asarray(lines[c])[index] for c in ("id", "n")}
        values["bitmap"] = np.asarray(lines["bitmap"]).view(W.U64)[index]
        if "wide" in lines:
            values["place"] = place | (np.asarray(lines["wide"].is_valid())[index] * CROWDED)
            values["wide"] = lines["wide"].take(pa.array(index))
        else:
            values["wide"] = pa.ListArray.from_arrays(pa.array(np.zeros(len(index) + 1, np.int32)), pa.array([], pa.int64()))
        return _block(word % np.uint32(parts), values, _WORD)

    return lambda batches: _dealt(batches, block)


_PAIR = pa.schema([("id", pa.int64()), ("other", pa.int64())])


def _at_most(longest: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """By the sum of two sets' words: words that they share if they are similar, at least, and words in one of them only, at most."""
    both = np.arange(2 * longest + 1)
    overlap = np.ceil(threshold / (1 + threshold) * both - 1e-9).astype(np.int32)
    return overlap, (both - 2 * overlap).astype(np.int32)


def _earliest(threshold: float):
    """Pairs of a line and the earliest one of a word in its prefix, of what a part has got."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x = _gathered(batches, _WORD)
        packed = (x["word"].astype(W.U64) << W.U64(32)) | np.arange(len(x["word"]), dtype=W.U64)
        packed.sort()
        order, word = (packed & W.U64(0xFFFFFFFF)).astype(np.int64), packed >> W.U64(32)
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
        if not len(start):
            return
        ids, size = x["id"][order], np.diff(np.append(start, len(word)))
        least = np.repeat(np.minimum.reduceat(ids, start), size)
        own = np.flatnonzero(ids == least)
        a, b = order, order[np.repeat(own[np.searchsorted(own, start)], size)]
        later = ids > least
        a, b = a[later], b[later]
        n, m, after_a, after_b = x["n"][a], x["n"][b], x["n"][a] - x["place"][a].astype(np.int32), x["n"][b] - x["place"][b].astype(np.int32)
        overlap, most = (x[n + m] for x in _at_most(int(x["n"].max()), threshold))
        fits = (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (np.minimum(after_a, after_b) >= overlap) & (np.bitwise_count(x["bitmap"][a] ^ x["bitmap"][b]) <= most)
        yield pa.RecordBatch.from_arrays([pa.array(x["id"][a[fits]]), pa.array(x["id"][b[fits]])], schema=_PAIR)

    return made


def _all(threshold: float):
    """Pairs of lines that share a word of their prefixes, of which the later isn't settled; a settled line has -1 - id for its id.

    The longer line of a pair shares a word of its prefix with the shorter line's first
    n - 2 * threshold / (1 + threshold) * n + 1 words. In order of word and size, the lines that one can be
    similar to are a run, so that lines of very different sizes never meet, however common their words are;
    settled lines meet open ones only. Two lines with wide bitmaps must pass these too.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x = _gathered(batches, _WORD)
        key = (x["word"].astype(W.U64) << W.U64(32)) | x["n"].astype(W.U64)
        order = np.argsort(key, kind="stable")
        word = x["word"][order]
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
        if not len(start):
            return
        size = np.diff(np.append(start, len(word)))
        meets = (size > 1) & np.logical_or.reduceat(x["id"][order] >= 0, start)
        order = order[np.repeat(meets, size)]
        wide_at = np.cumsum(x["place"] >= CROWDED)[order] - 1
        crowded, place = x["place"][order] >= CROWDED, (x["place"][order] & ~CROWDED).astype(np.int32)
        key, signed, n, bitmap, wide = key[order], x["id"][order], x["n"][order], x["bitmap"][order], x["wide"]
        open_, ids = signed >= 0, np.maximum(signed, -1 - signed)
        least = (key >> W.U64(32) << W.U64(32)) | np.ceil(threshold * n - 1e-9).astype(W.U64)
        short = place <= n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int32)
        overlap_of, most_of = _at_most(int(n.max(initial=0)), threshold)
        for longer, shorter in ((np.flatnonzero(open_), np.flatnonzero(short)), (np.flatnonzero(~open_), np.flatnonzero(short & open_))):
            low = np.searchsorted(key[shorter], least[longer])
            each = np.searchsorted(key[shorter], key[longer], "right") - low
            longer, low, each = longer[each > 0], low[each > 0], each[each > 0]
            total = np.cumsum(each)
            cuts = [0, *(np.flatnonzero(np.diff(total // PAIRS)) + 1).tolist(), len(each)]
            for u, v in zip(cuts, cuts[1:], strict=False):
                if u == v:
                    continue
                a = np.repeat(longer[u:v], each[u:v])
                b = shorter[np.arange(len(a)) + np.repeat(low[u:v] - (total[u:v] - each[u:v] - (total[u] - each[u])), each[u:v])]
                fits = np.bitwise_count(bitmap[a] ^ bitmap[b]) <= most_of[n[a] + n[b]]
                a, b = a[fits], b[fits]
                most = most_of[n[a] + n[b]]
                fits = np.minimum(n[a] - place[a], n[b] - place[b]) >= overlap_of[n[a] + n[b]]
                fits &= np.where(ids[a] > ids[b], open_[a], open_[b]) & ((n[a] > n[b]) | (ids[a] > ids[b]))
                both = np.flatnonzero(fits & crowded[a] & crowded[b])
                fits[both] = np.bitwise_count(wide[wide_at[a[both]]] ^ wide[wide_at[b[both]]]).sum(axis=1, dtype=np.int32) <= most[both]
                a, b = ids[a[fits]], ids[b[fits]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=_PAIR)

    return made


def judge(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key (hash of the text), n_lines and kept (numbers of the lines to keep, from 0) of each row of ``docs``.

    A line is removed if an earlier line, of this document or one with a smaller doc_id, has the
    same words or a word set with a Jaccard similarity of at least ``threshold``; whether that
    earlier line is removed too makes no difference. Lines are runs between \\n; those without a
    word are neither counted nor removed. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Documents of
    one id are in the order of their text's hash; a null id comes first; repeated rows are judged
    as one and both keep the same lines. Null and empty texts have no lines.

    Lines with one word set are one line, the earliest. Its words are ordered by rarity, and the
    prefix holds one of the words that any similar line must share with it. Each line is first
    tested against the earliest line that shares a prefix word; only lines that this doesn't settle
    are joined with all lines that share one. So a crowd of like lines makes few pairs, and the rest
    of them are still found. Bitmaps of words drop pairs that can't be similar before their sets are fetched.
    Where many lines meet one earlier line, those left are first tested against its nearest lines, and the
    crowd's lines get bitmaps of 512 bits, as those of 64 pass most near copies that are just not similar.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    n_lines, counts = counted(texts)
    rarities = docs.sparkSession.sparkContext.broadcast(ranks(counts))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // PART_WORDS + 1)
    bounds = docs.sparkSession.sparkContext.broadcast(limits_of(n_lines, parts))
    lines = texts.mapInArrow(_lines_dealt(rarities, threshold, parts), _typed(_SET)).repartitionById(parts, F.col("part"))
    lines = lines.mapInArrow(_firsts_dealt(bounds), _typed(_SET)).repartitionById(parts, F.col("part"))
    # Nearly all values differ, so that dictionaries would be made for nothing.
    firsts = written(lines.mapInArrow(_numbered, ", ".join(f"{c} {kind}" for c, kind in _FIRST.items())), **{"parquet.enable.dictionary": "false"})

    def exploded(lines: DataFrame, *others: str) -> DataFrame:
        """(id, packed: number of words and place, bitmap, word, ``others``) for each word of the prefixes."""
        words = lines.select("id", F.shiftleft(F.col("n").cast("long"), 32).alias("n"), "bitmap", *others, F.posexplode("prefix").alias("place", "word"))
        return words.select("id", (F.col("n") + F.col("place")).alias("packed"), "bitmap", "word", *others)

    def joined(lines: DataFrame, pairs_of: Callable, *others: str) -> DataFrame:
        """The pairs that ``pairs_of`` finds among the lines of each part of the prefix words."""
        blocks = lines.select("id", "n", "bitmap", "prefix", *others).mapInArrow(_words_dealt(parts), _typed(_WORD))
        return blocks.repartitionById(parts, F.col("part")).mapInArrow(pairs_of(threshold), "id long, other long").distinct()

    def ids_of(pairs: DataFrame) -> DataFrame:
        return cut(pairs.select("id").unionAll(pairs.select(F.col("other").alias("id"))).distinct())

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs that pass the 256-bit bitmaps."""
        signs = small(cut(firsts.select("id", "n", *SIGNS).join(small(ids_of(pairs)), "id", "left_semi")))
        a, b = signs.alias("a"), signs.alias("b")
        differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in SIGNS])
        n = F.col("a.n") + F.col("b.n")
        both = pairs.alias("p").join(a, F.col("p.id") == F.col("a.id")).join(b, F.col("p.other") == F.col("b.id"))
        return both.filter(differ <= n - 2 * F.ceil(threshold / (1 + threshold) * n - 1e-9)).select("p.id", "p.other")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """id, tokens, wide of the lines of the pairs."""
        ids = ids_of(pairs)
        asked = cut(firsts.select("id", "doc_id", "key", "line").join(small(ids), "id", "left_semi"))
        asked = cut(asked.groupBy("doc_id", "key").agg(F.collect_list(F.struct("line", "id")).alias("asked")))
        found = texts.alias("t").join(small(asked).alias("a"), F.expr("t.doc_id <=> a.doc_id AND t.key = a.key")).select("t.text", "a.asked")
        sets = cut(found.mapInArrow(_sets, "id long, tokens array<long>, wide array<long>"))
        if sets.count() > ids.count():  # repeated rows give their lines' sets once each
            sets = cut(sets.dropDuplicates(["id"]))
        return sets

    def tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs with their similarity (id, other, alike)."""
        a, b = sets.select("id", F.col("tokens").alias("mine")), sets.select(F.col("id").alias("other"), F.col("tokens").alias("others"))
        both = F.size(F.array_intersect("mine", "others"))
        known = pairs.join(a, "id").join(b, "other").withColumn("both", both)
        return cut(known.select("id", "other", (F.col("both") / (F.size("mine") + F.size("others") - F.col("both"))).alias("alike")))

    def similar(known: DataFrame) -> DataFrame:
        """Lines of which a pair's similarity is high enough."""
        return known.filter(F.col("alike") >= threshold).select("id").distinct()

    def hub_pairs(members: DataFrame, settled: DataFrame) -> DataFrame:
        """Pairs of a line that isn't settled and a hub of a crowd, at most ``HUBS`` for each word of the line's prefix.

        Of near copies of one line, those nearest to another copy have the fewest changes, and the more of the rest are like them.
        """
        ranked = [members.select("id", F.row_number().over(Window.partitionBy("other").orderBy(*order)).alias("rank")) for order in ((F.desc("alike"), "id"), ("id",))]
        hubs = cut(reduce(DataFrame.unionAll, [x.filter(F.col("rank") <= HUBS) for x in ranked]).groupBy("id").agg(F.min("rank").alias("rank")))
        words = exploded(firsts.join(small(hubs), "id"), "rank").withColumn("nth", F.row_number().over(Window.partitionBy("word").orderBy("rank", "id")))
        words = small(cut(words.filter(F.col("nth") <= HUBS).select("id", "packed", "bitmap", "word")))
        lines = exploded(firsts.join(small(settled), "id", "left_anti"))
        on = (F.col("a.word") == F.col("b.word")) & (F.col("a.id") != F.col("b.id")) & _fits("a", "b", threshold)
        return lines.alias("a").join(words.alias("b"), on).select(F.greatest("a.id", "b.id").alias("id"), F.least("a.id", "b.id").alias("other")).distinct()

    pairs = cut(joined(firsts, _earliest))
    sets = sets_of(pairs)
    known = tested(pairs, sets)
    settled = cut(similar(known))
    crowds = cut(known.groupBy("other").agg(F.count("*").alias("lines")).filter(F.col("lines") >= CROWD).select("other"))
    facts, bitmaps = settled.select("id", F.lit(True).alias("settled"), F.lit(None).cast("array<long>").alias("wide")), []
    if not crowds.isEmpty():
        members = cut(known.join(small(crowds), "other", "left_semi"))
        pairs = cut(hub_pairs(members, settled))
        others = sets_of(pairs)
        settled = cut(settled.unionAll(similar(tested(pairs, others))).distinct())
        crowded = cut(members.select("id").unionAll(crowds.select(F.col("other").alias("id"))).distinct())
        wide = sets.join(small(crowded), "id", "left_semi").unionAll(others).select("id", F.lit(None).cast("boolean").alias("settled"), "wide")
        facts = settled.select("id", F.lit(True).alias("settled"), F.lit(None).cast("array<long>").alias("wide")).unionAll(wide)
        facts = cut(facts.groupBy("id").agg(F.max("settled").alias("settled"), F.max("wide").alias("wide")))
        bitmaps = ["wide"]
    marked = firsts.join(small(facts), "id", "left")
    marked = marked.withColumn("id", F.when(F.col("settled").isNull(), F.col("id")).otherwise(-1 - F.col("id")))
    pairs = cut(likely(cut(joined(marked, _all, *bitmaps))))
    rest = similar(tested(pairs, sets_of(pairs)))
    gone = cut(settled.unionAll(rest))
    kept = cut(firsts.join(small(gone), "id", "left_anti").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.col("line").cast("long"))).alias("kept")))
    unwritten(firsts)
    rows = n_lines.alias("t").join(kept.alias("k"), F.expr("t.doc_id <=> k.doc_id AND t.key = k.key"), "left")
    return rows.select("t.doc_id", "t.key", "n_lines", F.coalesce("kept", F.array().cast("array<long>")).alias("kept"))


def apply(docs: DataFrame, judged: DataFrame, length: str | None = "n_chars") -> DataFrame:
    """``docs`` with the texts that :func:`judge` leaves; a column ``length`` gets the new number of characters.

    Lines without a word stay where they are. A document that loses all its words is dropped.
    """
    of, hashed, left = fresh(docs, "id", "key", "kept")
    losing = judged.filter(F.size("kept") < F.col("n_lines")).select(F.col("doc_id").alias(of), F.col("key").alias(hashed), F.col("kept").alias(left))
    losing = cut(losing.dropDuplicates([of, hashed]))
    rows = docs.join(small(losing), F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & F.xxhash64("text").eqNullSafe(F.col(hashed)), "left")
    rows = rows.drop(of, hashed)
    names, schema, count = docs.columns, docs.schema, length if length in docs.columns else None

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            texts, stay = [], []
            for text, kept in zip(batch.column("text").to_pylist(), batch.column(left).to_pylist(), strict=True):
                if kept is not None:
                    numbers = set(kept)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k in numbers or not x.encode().split())
                texts.append(text)
                stay.append(kept is None or len(kept) > 0)
            out = []
            for name in names:
                column = batch.column(name)
                if name == "text":
                    column = pa.array(texts, column.type)
                elif name == count:
                    sizes = [None if t is None else len(t) for t in texts]
                    column = pa.array([old if k is None else n for old, n, k in zip(column.to_pylist(), sizes, batch.column(left).to_pylist(), strict=True)], column.type)
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(stay))

    return rows.mapInArrow(cleaned, schema)
