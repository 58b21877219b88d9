"""Command line: ``python -m kinfold candidates | evaluate | validate``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import blocking, evaluate
from .sources import entities, store


def _candidates(spark: SparkSession, a: argparse.Namespace) -> int:
    """Lists of candidates for every first-source entity."""
    caps = {"rare_bigram": a.bigram_freq, "rare_brand": a.brand_freq}
    channels = tuple(blocking.Channel(c.name, c.keys, c.prio, c.least, caps.get(c.name, c.most), c.pattern, c.country) for c in blocking.CHANNELS)
    q, *t = (store.written(blocking.normalize(entities.read_entities(spark, p))) for p in (a.source1, *a.targets))
    targets = t[0]
    for more in t[1:]:
        targets = targets.unionByName(more)
    found = blocking.candidates(q, targets, channels, a.top_k or None)
    entities.write_lists(entities.lists(q, found, "candidate_entity_ids"), a.output)
    return 0


def _lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="")


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Macro F0.5 of a result against the truth, over all first-source entities."""
    pred, true = _lists(spark, a.pred), _lists(spark, a.gt)
    asked = entities.ids(_lists(spark, a.s1ids)) if a.s1ids else true.select(F.col("source1_entity_id").alias("entity_id"))
    rows = evaluate.per_entity(asked, entities.parse_links(true), entities.parse_links(pred))
    for name, value in evaluate.macro(rows).first().asDict().items():
        print(f"{name}\t{value}")
    if a.verbose:
        for r in rows.orderBy("f05", "entity_id").limit(20).collect():
            print(f"{r.entity_id}\t{r.f05}")
    return 0


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Errors and warnings on result files; 1 if there is an error."""
    required = entities.ids(_lists(spark, a.source1))
    targets = None
    for path in a.check_ids or ():
        more = entities.ids(_lists(spark, path))
        targets = more if targets is None else targets.unionByName(more)
    candidates = entities.parse_links(_lists(spark, a.candidate), targets="candidate_entity_ids") if a.candidate else None
    errors, warnings = evaluate.validate(spark, a.matching, required, candidates, targets)
    if a.candidate:
        more_errors, more_warnings = evaluate.validate(spark, a.candidate, required, None, targets, "candidate_entity_ids")
        errors, warnings = errors + more_errors, warnings + more_warnings
    for kind, found in (("error", errors), ("warning", warnings)):
        for x in found:
            print(f"{kind}\t{x}")
    return int(bool(errors))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinfold")
    commands = parser.add_subparsers(required=True)
    c = commands.add_parser("candidates")
    c.add_argument("--source1", required=True)
    c.add_argument("--targets", nargs="+", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--top-k", type=int, default=40, help="candidates of a query at most; 0: all")
    c.add_argument("--bigram-freq", type=int, default=500)
    c.add_argument("--brand-freq", type=int, default=300)
    c.set_defaults(run=_candidates)
    e = commands.add_parser("evaluate")
    e.add_argument("--pred", required=True)
    e.add_argument("--gt", required=True)
    e.add_argument("--s1ids")
    e.add_argument("--verbose", action="store_true")
    e.set_defaults(run=_evaluate)
    v = commands.add_parser("validate")
    v.add_argument("--matching", required=True)
    v.add_argument("--source1", required=True)
    v.add_argument("--candidate")
    v.add_argument("--check-ids", nargs="+", help="files of the targets, whose ids have to exist")
    v.set_defaults(run=_validate)
    a = parser.parse_args(arguments)
    return a.run(SparkSession.builder.appName("kinfold").getOrCreate(), a)


if __name__ == "__main__":
    raise SystemExit(main())
