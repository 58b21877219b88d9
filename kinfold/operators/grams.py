"""Character n-grams of names in numpy: counted for an index, and searched with every pair's sum held in place, never as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Targets whose postings are held at once, about 35 MB for names of 35 letters, and rows whose n-grams are made at once.
BLOCK, SLICE = 1 << 16, 1 << 13


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xA24BAED4963EE407)
    return x ^ (x >> U64(32))


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """Rows in order of part, side and id, by 2 * part + side; targets (side 1) in blocks of about ``size``, no id in two of them."""
    held: list[pa.RecordBatch] = []
    now, n = -1, 0
    for batch in batches:
        tags = 2 * batch.column("part").to_numpy().astype(np.int64) + batch.column("side").to_numpy()
        at = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(tags)]
        for a, b in zip(at, at[1:], strict=False):
            if a == b:
                continue
            if held and tags[a] != now:
                yield now, pa.Table.from_batches(held)
                held, n = [], 0
            now = int(tags[a])
            held.append(batch.slice(a, b - a))
            n += b - a
            if now % 2 and n >= size:
                whole = pa.Table.from_batches(held).combine_chunks()
                ids = whole.column("id")
                last = pc.index(ids, ids[-1]).as_py()
                if last > 0:
                    yield now, whole.slice(0, last)
                    held, n = whole.slice(last).to_batches(), len(whole) - last
    if held:
        yield now, pa.Table.from_batches(held)


def _entities(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The ids of rows in order of id, each once, and each row's place among them."""
    ids = pa.concat_arrays(rows.column("id").cast(pa.large_string()).chunks)
    code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    new = np.append(True, code[1:] != code[:-1])[: len(code)]
    return ids.take(pa.array(np.flatnonzero(new))), np.cumsum(new) - 1


def _grams(rows: pa.Table, sizes: tuple[int, ...]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size the text of all rows, and where in it n-grams begin, their rows and their hashes.

    A row's text has its words with a blank on both sides, so that two blanks are where a word ends.
    """
    texts = rows.column("text")
    text = "".join(texts.to_pylist())
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64)
    begins = np.append(0, np.cumsum(np.asarray(pc.utf8_length(texts), np.int64)))
    shard = _mix(rows.column("shard_hash").to_numpy().view(U64))
    ends = np.append(0, np.cumsum((letters[:-1] == 32) & (letters[1:] == 32))) if len(letters) else np.zeros(0, np.int64)
    for n in sizes:
        places = max(len(letters) - n + 1, 0)
        start = np.flatnonzero(ends[n - 1 : n - 1 + places] == ends[:places])
        row = np.searchsorted(begins, start, "right") - 1
        found = _mix(shard[row] + U64(n))
        for k in range(0, n, 3):  # three letters of 21 bits at a time
            three = letters[start + k]
            for j in range(k + 1, min(k + 3, n)):
                three = three | (letters[start + j] << U64(21 * (j - k)))
            found = _mix(found ^ three)
        yield n, text, start, row, found


def counted(sizes: tuple[int, ...]):
    """(shard, gram, hash, df, all) of each block of entities: in how many each n-gram is, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _pieces(batches, SLICE):
            _, entity = _entities(rows)
            shards = rows.column("shard").combine_chunks()
            for n, text, start, row, found in _grams(rows, sizes):
                order = np.lexsort((entity[row], found))
                hashes, of = found[order], entity[row][order]
                new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
                first = np.flatnonzero(new)
                each = new | np.append(True, of[1:] != of[:-1])[: len(of)]
                if not len(first):
                    continue
                at = order[first]
                grams = [text[i : i + n] for i in start[at].tolist()]
                df, every = np.add.reduceat(each.astype(np.int64), first), np.diff(np.append(first, len(hashes)))
                yield pa.RecordBatch.from_arrays([shards.take(pa.array(row[at])), pa.array(grams), pa.array(hashes[first].view(np.int64)), pa.array(df), pa.array(every)], names=["shard", "gram", "hash", "df", "all"])

    return run


class Known:
    """The grams of an index: hashes, in order, and idf; found by a hash's upper bits, as hashes are spread evenly."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], idf[order]
        self.shift = U64(64 - max(8, len(idf).bit_length() + 1))
        self.begins = np.append(0, np.cumsum(np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))))
        self.most = int(np.diff(self.begins).max())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` the index has, and their places in it."""
        at = self.begins[(hashes >> self.shift).astype(np.int64)]
        place = np.full(len(hashes), -1)
        for k in range(self.most):
            here = np.minimum(at + k, len(self.idf) - 1)
            np.copyto(place, here, where=self.hashes[here] == hashes)
        known = np.flatnonzero(place >= 0)
        return known, place[known]


def _vectors(rows: pa.Table, sizes: tuple[int, ...], index: Known, by_gram: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and entity, gram and weight of what the index knows, in order of entity or of gram; each entity's weights have length 1."""
    ids, entity = _entities(rows)
    packed = []
    for a in range(0, len(rows), SLICE):
        for _, _, _, row, found in _grams(rows.slice(a, SLICE), sizes):
            known, gram = index.find(found)
            of = entity[a + row[known]]
            high, low = (gram, of) if by_gram else (of, gram)
            packed.append((high.astype(U64) << U64(32)) | low.astype(U64))
    both, tf = np.unique(np.concatenate(packed), return_counts=True)
    high, low = (both >> U64(32)).astype(np.int64), (both & U64(0xFFFFFFFF)).astype(np.int64)
    of, gram = (low, high) if by_gram else (high, low)
    weight = (1 + np.log(tf)) * index.idf[gram]
    return ids, of, gram, weight / np.sqrt(np.bincount(of, weight * weight, len(ids)))[of]


def _where(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values, eight looked at together."""
    whole = np.zeros(-(-len(mask) // 8) * 8, bool)
    whole[: len(mask)] = mask
    at = (np.flatnonzero(whole.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return at[whole[at]]


class _Best:
    """The best targets so far of each query of a part; targets come in order of id, so that later ones lose ties."""

    def __init__(self, rows: pa.Table, sizes: tuple[int, ...], index: Known, k: int | None, least: float):
        self.sizes, self.index, self.k, self.least = sizes, index, k, least
        self.ids, of, self.gram, self.weight = _vectors(rows, sizes, index, by_gram=False)
        self.first = np.searchsorted(of, np.arange(len(self.ids) + 1)).tolist()
        self.score, self.target = ([np.zeros(0, x) for _ in range(len(self.ids))] for x in (float, np.int64))
        self.targets: list[pa.Array] = []
        self.base = 0

    def meet(self, rows: pa.Table) -> None:
        ids, of, gram, weight = _vectors(rows, self.sizes, self.index, by_gram=True)
        begins = np.searchsorted(gram, np.arange(len(self.index.idf) + 1))
        for q, (a, b) in enumerate(zip(self.first, self.first[1:], strict=False)):
            grams, mine = self.gram[a:b], self.weight[a:b].tolist()
            runs = [(i, j, x) for i, j, x in zip(begins[grams].tolist(), begins[grams + 1].tolist(), mine, strict=True) if i < j]
            if not runs:
                continue
            sums = np.bincount(np.concatenate([of[i:j] for i, j, _ in runs]), np.concatenate([weight[i:j] * x for i, j, x in runs]))
            score, target = self.score[q], self.target[q]
            full = self.k is not None and len(score) >= self.k
            low = score[-1] if full and len(score) else self.least
            at = _where(sums >= max(low - 1e-6, 5e-324))
            found = np.round(sums[at], 6)
            better = found > low if full else found >= low
            if self.k != 0 and better.any():
                score, target = np.append(score, found[better]), np.append(target, at[better] + self.base)
                order = np.argsort(-score, kind="stable")[: self.k]
                self.score[q], self.target[q] = score[order], target[order]
        self.targets.append(ids)
        self.base += len(ids)

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What has been found, some queries at a time."""
        targets = pa.concat_arrays(self.targets) if self.targets else pa.array([], pa.large_string())
        for a in range(0, len(self.score), 512):
            score, target = self.score[a : a + 512], self.target[a : a + 512]
            query = np.repeat(np.arange(a, a + len(score)), [len(x) for x in score])
            if len(query):
                columns = [self.ids.take(pa.array(query)), targets.take(pa.array(np.concatenate(target)))]
                yield pa.RecordBatch.from_arrays([*[c.cast(pa.string()) for c in columns], pa.array(np.concatenate(score))], names=["entity_id", "target_id", "score"])
        self.score, self.target = ([np.zeros(0, x) for _ in range(len(self.ids))] for x in (float, np.int64))
        self.targets, self.base = [], 0


def searched(index, sizes: tuple[int, ...], k: int | None, least: float):
    """(entity_id, target_id, score): the ``k`` best targets of each query, of partitions in order of part, side and id.

    ``index`` is a broadcast of the grams' hashes and their idf. One block of targets is inverted at a time;
    without ``k`` what is found in a block leaves with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, part, known = None, -1, Known(*index.value)
        for tag, rows in _pieces(batches, BLOCK):
            if tag % 2 == 0:
                if best:
                    yield from best.taken()
                best, part = _Best(rows, sizes, known, k, least), tag // 2
            elif best and tag // 2 == part:
                best.meet(rows)
                if k is None:
                    yield from best.taken()
        if best:
            yield from best.taken()

    return run
