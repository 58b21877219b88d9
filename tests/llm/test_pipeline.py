"""The five stages in plain Python, row by row, against run() and against one another."""

import hashlib
import re

import corpus_pipeline as pipeline
from tests.llm.test_operators import SCHEMA, WORD, corpus, judged, low, shared_corpus

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def without_lines(rows):
    """Lines go that an earlier one is like; texts that lose all their words go."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = [], {}
    for k in order:
        kept, words, lost = [], False, False
        for line in (rows[k][1] or "").split("\n"):
            s = frozenset(WORD.findall(line))
            if s and any(len(s & t) >= 0.8 * len(s | t) for t in seen):
                lost = True
            else:
                kept.append(line)
                words |= bool(s)
            if s:
                seen.append(s)
        if not lost:
            out[k] = rows[k]
        elif words:
            text = "\n".join(kept)
            out[k] = (rows[k][0], text, *rows[k][2:4], len(text))
    return [out[k] for k in sorted(out)]


def one_of_each(rows):
    sets = []
    for k, r in enumerate(rows):
        w = WORD.findall(r[1] or "")
        n = min(5, len(w))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else {k})
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        first.setdefault(root[k], k)
    return [rows[k] for k in sorted(first.values())]


def clean_of(rows, items):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {tuple(w[k : k + min(10, len(w))]) for w in (words.findall(low(t)) for t in items) for k in range(max(len(w) - 9, 1)) if w}
    return [r for r in rows if not any(tuple(w[k : k + n]) in windows for w in [words.findall(low(r[1]))] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))]


def mixed(rows):
    sizes = [len(WORD.findall(r[1] or "")) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[3] == s) for s in names}
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, SHARE * sum(sizes), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > MOST * total[s]]
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = MOST * total[s]
            left -= target[s]
            free.remove(s)
    out = []
    for s in names:
        u = int(hashlib.md5(f"7:{s or ''}".encode()).hexdigest()[:12], 16) / (1 << 48)
        step = target[s] / total[s] if total[s] else 0.0
        ranked = sorted((n, r[0]) for n, r in zip(sizes, rows, strict=True) if r[3] == s)
        for k, (n, i) in enumerate(ranked, 1):
            copies = int(u + k * step) - int(u + (k - 1) * step)
            out.append((i, s, n, total[s], round(target[s], 6), copies, copies * n))
    return out


def test_stages(spark, tmp_path):
    near = corpus(4)
    rows = [r[:5] for r in shared_corpus() if r[0] is not None]
    rows += [(2000 + r[0], *r[1:5]) for r in near[:40]] + [(3000 + r[0], (r[1] or "").replace("\n", "  ") or None, *r[2:5]) for r in near[:40]]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[:5])).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    items = [" ".join(next(r[1] for r in rows if r[0] == 2003).split()[:14]), "never there at all", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(*r[:1], j[-1] if j[-3] else r[1], *r[2:4], len(j[-1]) if j[-3] else r[4]) for r, j in zip(rows, judged(rows), strict=True) if j[-2]]
    expected = [kept]
    for step in (without_lines, one_of_each, lambda x: clean_of(x, [t for t in items if t]), mixed):
        expected.append(step(expected[-1]))
    assert all(a != b for a, b in zip([rows, *expected], expected, strict=False))  # each stage has something to do

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, ((_, stage), whole) in enumerate(zip(pipeline.STAGES, expected, strict=True)):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, whole))
    got = pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    assert sorted(str((*r[:4], round(r.target, 6), *r[5:])) for r in got) == sorted(map(str, expected[-1]))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], ", ".join(SCHEMA.split(", ")[:5])).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
