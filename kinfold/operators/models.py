"""Learned scores on pyspark.ml: splits, folds, models, blending and stacking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from .evaluate import f_half


def dealt(seed: int = 2026) -> Column:
    """A number for each query, the same in each run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("entity_id")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def fold(n: int, seed: int = 2026) -> Column:
    """Fold of a query: all its pairs are in one."""
    return F.pmod(dealt(seed), F.lit(n)).cast("int")


def split(rows: DataFrame, share: float = 0.7, seed: int = 2026) -> tuple[DataFrame, DataFrame]:
    """Queries for training and the others, with all their pairs."""
    low = dealt(seed) % 10_000 < round(share * 10_000)
    return rows.filter(low), rows.filter(~low)


def sampled(rows: DataFrame, share: float, seed: int = 2026) -> DataFrame:
    """That share of the entities, the same in each run."""
    return rows.filter(dealt(seed) % 1_000_000 < round(share * 1_000_000))


def stratified(rows: DataFrame, strata: list[str], n: int, seed: int = 2026) -> DataFrame:
    """``n`` rows of each stratum, the same in each run."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("entity_id")).cast("binary")), "entity_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def negatives(labelled: DataFrame, k: int = 40) -> DataFrame:
    """All positive pairs and each query's ``k`` best negative ones."""
    rank = F.row_number().over(Window.partitionBy("entity_id", "label").orderBy(F.desc("max_prio"), F.desc("n_channels"), "target_id"))
    return labelled.withColumn("rank", rank).filter((F.col("label") == 1) | (F.col("rank") <= k)).drop("rank")


def weights(labelled: DataFrame, hard: float = 2.0) -> DataFrame:
    """Classes weigh alike; like names at unlike addresses weigh ``hard`` times. The share of links is one broadcast row."""
    share = labelled.agg(F.avg("label").alias("share"))
    tough = (F.col("name_jw") > 0.9) & (F.col("addr_tok_jac") < 0.2) & (F.col("addr_null_tgt") == 0) & (F.col("label") == 0)
    balance = F.least(F.lit(50.0), (1 - F.col("share")) / F.greatest("share", F.lit(1e-9)))
    return labelled.crossJoin(F.broadcast(share)).withColumn("weight", F.when(F.col("label") == 1, balance).when(tough, hard).otherwise(1.0)).drop("share")


def logistic(columns: list[str], n: int, c: float = 1.0, weight: str | None = None) -> Pipeline:
    """Logistic regression on standardised columns; the penalty 1 / (c n) follows the number ``n`` of rows."""
    model = LogisticRegression(labelCol="label", featuresCol="scaled", regParam=1.0 / (c * max(n, 1)), **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), model])


def boosted(columns: list[str], trees: int = 20, depth: int = 4, seed: int = 2026) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), GBTClassifier(labelCol="label", featuresCol="raw", maxIter=trees, maxDepth=depth, seed=seed)])


def score(model, rows: DataFrame, name: str = "p") -> DataFrame:
    found = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return found.select(*rows.columns, name)


def side_by_side(pipeline: Pipeline, tables: list[DataFrame]) -> list[PipelineModel]:
    """A model of each table, fitted at the same time: one fit's short jobs leave most of a cluster idle."""
    if not tables:
        return []
    with ThreadPool(len(tables)) as pool:
        return pool.map(inheritable_thread_target(tables[0].sparkSession)(pipeline.fit), tables)


def out_of_fold(pipeline: Pipeline, rows: DataFrame, folds: int = 5, name: str = "p") -> DataFrame:
    """Each row scored by a model that hasn't seen its query; every fold uses the same inputs."""
    marked = rows.withColumn("fold", fold(folds))
    models = side_by_side(pipeline, [marked.filter(F.col("fold") != k) for k in range(folds)])
    return reduce(DataFrame.unionByName, [score(model, marked.filter(F.col("fold") == k), name) for k, model in enumerate(models)]).drop("fold")


def _passed(rows: DataFrame, measure) -> list[np.ndarray]:
    """What ``measure`` makes of the arrays x, label and fold of each batch, as an array of doubles for each task, made in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                total = measure(total, x, b.column("label").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False))
        if total is not None:
            yield pa.record_batch({"total": pa.array([total.tobytes()], pa.binary())})

    wanted = rows.select("x", F.col("label").cast("double"), F.col("fold").cast("int"))
    return [np.frombuffer(r.total) for r in wanted.mapInArrow(run, "total binary").collect()]


def logistic_without(rows: DataFrame, left: list[int], n: int, c: float = 1.0) -> list[tuple[list[float], float]]:
    """What :func:`logistic` is after, for each fold in ``left`` on the rows (x array<double>, label, fold) of all others.

    Newton's steps on the same loss: columns standardised by the rows of the fit, mean loss, penalty 1 / (c n), intercept
    free. One pass over the rows is a step of all fits, and they end at the optimum, which few steps reach. ``rows``
    should be stored. Returns (weights, intercept) for the columns as they are.
    """
    every = np.array(left)

    def moments(total, x, y, f):
        with_ones = np.column_stack([np.ones(len(x)), y, x])
        new = [np.concatenate([u.T @ with_ones, np.where(u[:, None], x, np.inf).min(0), np.where(u[:, None], x, -np.inf).max(0)]) for u in (f != k for k in every)]
        new = np.stack(new)
        if total is None:
            return new
        d = x.shape[1]
        return np.concatenate([total[:, : d + 2] + new[:, : d + 2], np.minimum(total[:, d + 2 : -d], new[:, d + 2 : -d]), np.maximum(total[:, -d:], new[:, -d:])], axis=1)

    parts = [p.reshape(len(left), -1) for p in _passed(rows, moments)]
    if not parts:
        raise ValueError("no rows to fit a model on")
    d = (parts[0].shape[1] - 2) // 3
    sums = sum(p[:, : d + 2] for p in parts)
    if not np.isfinite(sums).all():
        raise ValueError("a feature is null or no number")
    least, most = np.min([p[:, d + 2 : -d] for p in parts], axis=0), np.max([p[:, -d:] for p in parts], axis=0)
    size, links, means = sums[:, 0], sums[:, 1], sums[:, 2:] / np.maximum(sums[:, :1], 1)
    if not size.all():
        raise ValueError("all rows are in one fold")

    def squares(total, x, y, f):
        new = np.stack([((f != k) @ np.square(x - m)) for k, m in zip(every, means, strict=True)])
        return new if total is None else total + new

    spread = np.sqrt(sum(p.reshape(len(left), d) for p in _passed(rows, squares)) / np.maximum(size - 1, 1)[:, None])
    scale = np.where(most > least, 1 / np.where(spread > 0, spread, 1), 0.0)  # as in StandardScaler, a constant column counts for nothing
    penalty = np.append(np.full(d, 1.0 / (c * max(n, 1))), 0.0)
    # With labels of one kind only, the intercept is infinite and the weights are 0.
    kinds = (links > 0) & (links < size)
    with np.errstate(divide="ignore"):
        start = np.log(links) - np.log(size - links)
    best = np.column_stack([np.zeros((len(left), d)), start])
    ahead, loss, step = best.copy(), np.full(len(left), np.inf), np.zeros_like(best)
    todo = np.flatnonzero(kinds)
    while len(todo):
        fits = [(every[i], means[i], scale[i], ahead[i]) for i in todo]

        def curve(total, x, y, f, fits=fits):
            out = []
            for k, m, s, w in fits:
                u = f != k
                z, t = np.column_stack([(x[u] - m) * s, np.ones(u.sum())]), y[u]
                margin = z @ w
                p = 0.5 * (1 + np.tanh(margin / 2))
                out.append(np.concatenate([[(np.logaddexp(0, margin) - t * margin).sum()], z.T @ (p - t), (z.T @ (z * (p * (1 - p))[:, None])).ravel()]))
            new = np.stack(out)
            return new if total is None else total + new

        found, left_over = sum(p.reshape(len(todo), -1) for p in _passed(rows, curve)), []
        for i, row in zip(todo, found, strict=True):
            row = row / size[i]
            now = row[0] + (penalty * np.square(ahead[i])).sum() / 2
            if now > loss[i] + 1e-13:
                step[i] /= 2  # too far: half of the step, from where it was taken
            else:
                best[i], loss[i] = ahead[i], now
                # A constant column's row is its penalty only, so that there is always a solution.
                slope, bend = row[1 : d + 2] + penalty * best[i], row[d + 2 :].reshape(d + 1, d + 1) + np.diag(penalty)
                step[i] = -np.linalg.solve(bend, slope)
                if -slope @ step[i] < 1e-12:
                    continue
            ahead[i] = best[i] + step[i]
            if np.abs(step[i]).max() > 1e-12:
                left_over.append(i)
        todo = np.array(left_over, dtype=int)
    weights = best[:, :d] * scale
    return [(w.tolist(), float(b - w @ m)) for w, b, m in zip(weights, best[:, d], means, strict=True)]


def logistic_score(fits: list[tuple[list[float], float]], at: Column) -> Column:
    """Score of a row's x by the ``at``-th of the fits."""
    weights, intercept = F.get(F.lit([w for w, _ in fits]), at), F.get(F.lit([b for _, b in fits]), at)
    products = F.zip_with("x", weights, lambda a, b: a * b)
    return 1 / (1 + F.exp(-(F.aggregate(products, F.lit(0.0), lambda s, v: s + v) + intercept)))


def blend(alpha: float, a: str, b: str) -> Column:
    return alpha * F.col(a) + (1 - alpha) * F.col(b)


def mixtures(names: list[str], steps: int) -> list[tuple[float, ...]]:
    """All weights of the names in ``steps``-ths that add up to 1."""
    if len(names) == 1:
        return [(1.0,)]
    out: list[tuple[int, ...]] = [()]
    for _ in names[:-1]:
        out = [(*x, k) for x in out for k in range(steps + 1 - sum(x))]
    return [(*(k / steps for k in x), (steps - sum(x)) / steps) for x in out]


def mixture_grid(entities: DataFrame, truth: DataFrame, scored: DataFrame, names: list[str], steps: int, thetas: list[float]) -> DataFrame:
    """Macro F0.5 of each mixture of the scores ``names`` at each threshold: (mixture, theta, macro_f05).

    The grid is a small array beside each pair, and everything is counted in one aggregation.
    """
    marked = scored.join(truth.withColumn("t", F.lit(1)), ["entity_id", "target_id"], "left")
    every = [F.struct(F.lit(k).alias("mixture"), F.round(sum(w * F.col(n) for w, n in zip(ws, names, strict=True)), 6).alias("p")) for k, ws in enumerate(mixtures(names, steps))]
    rows = marked.select("entity_id", "t", F.explode(F.array(*every)).alias("x")).select("entity_id", "t", "x.mixture", "x.p")
    over = F.filter(F.array(*[F.lit(x) for x in thetas]), lambda x: x <= F.col("p"))
    hits = rows.select("entity_id", "mixture", "t", F.explode(over).alias("theta")).groupBy("entity_id", "mixture", "theta").agg(F.count(F.lit(1)).alias("n_pred"), F.count("t").alias("tp"))
    true = truth.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_true"))
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("mixture"), F.lit(x).alias("theta")) for k in range(len(every)) for x in thetas])).alias("g")
    base = entities.select("entity_id").join(true, "entity_id", "left").select("entity_id", F.coalesce("n_true", F.lit(0)).alias("n_true"), grid).select("entity_id", "n_true", "g.*")
    whole = base.join(hits, ["entity_id", "mixture", "theta"], "left").fillna(0, ["n_pred", "tp"])
    return whole.groupBy("mixture", "theta").agg(F.round(F.avg(f_half(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 6).alias("macro_f05"))


def importances(model, columns: list[str]) -> dict[str, float]:
    """What a fitted pipeline's last stage says of each column: gains of trees, or coefficients."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else last.coefficients.toArray()
    return dict(zip(columns, map(float, values), strict=True))


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def ranked_pairs(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Feature differences of a query's positive and negative pairs, each once."""
    a = labelled.filter("label = 1").select("entity_id", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = labelled.filter("label = 0").select("entity_id", *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, "entity_id").select(*[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in columns])


def both_ways(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Differences as they are, labelled 1, and the other way round, labelled 0, for a pairwise ranker.

    ``pairs`` should be stored: a model reads them once for each of its steps, and plans whatever is behind them each time.
    """
    return pairs.select(*columns, F.lit(1).alias("label")).unionAll(pairs.select(*[(-F.col(c)).alias(c) for c in columns], F.lit(0).alias("label")))


def ablation(rows: DataFrame, groups: dict[str, list[str]], make) -> dict[str, Pipeline]:
    """A fitted model without each group of features."""
    every = [c for g in groups.values() for c in g]
    return {name: make([c for c in every if c not in left]).fit(rows) for name, left in groups.items()}
