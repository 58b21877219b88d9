from collections import Counter
from math import log, sqrt
from types import SimpleNamespace

from pyspark.sql import functions as F

from kinfold.operators import blocking as B, decide as D, evaluate as E, grams as G, models as M
from kinfold.plans import queries as Q
from kinfold.sources import entities as N

SCHEMA = N.ENTITY
QUERIES = [("s1_001", "Apex Solutions Pvt Ltd", "12 Main Street, Springfield, IL", "US"), ("s1_002", "Green Valley Inc", "45 Oak Avenue, Shelby, NC", "US"), ("s1_003", "Tech Corp", None, "US")]
TARGETS = [
    ("t2_001", "Apex Solutions Pvt Ltd", "12 Main Street, Springfield, IL", "US"), ("t2_002", "Solutions Apex", "12 Main St, Springfield, Illinois", "US"), ("t2_003", "GreenValley Enterprises", "45 Oak Avenue, Shelby, NC", "US"),
    ("t2_004", "Apex Solutions Pvt Ltd", "12 Main Street, Springfield, IL", "INDIA"), ("t2_005", "Unrelated Business XYZ", "999 Nowhere Road", "US"),
]


def sides(spark):
    return B.normalize(spark.createDataFrame(QUERIES, SCHEMA)), B.normalize(spark.createDataFrame(TARGETS, SCHEMA))


def test_blocking(spark):
    q, t = sides(spark)
    found = {(r.entity_id, r.target_id) for r in B.candidates(q, t).collect()}
    assert {("s1_001", "t2_001"), ("s1_001", "t2_002"), ("s1_002", "t2_003")} <= found
    assert all(x[1] not in ("t2_004", "t2_005") for x in found)
    per = B.candidates(q, t, k=1).groupBy("entity_id").count().collect()
    assert all(r["count"] == 1 for r in per)
    assert B.candidates(q.limit(0), t).count() == 0 and B.candidates(q, t.limit(0)).count() == 0
    blank = q.filter("entity_id = 's1_003'").first()
    assert (blank.std_address, blank.sorted_addr, blank.postal_code) == ("", "", "")


def test_lists_keep_empty_entities(spark, tmp_path):
    q, t = sides(spark)
    out = str(tmp_path / "lists")
    N.write_lists(N.lists(q, B.candidates(q, t)), out)
    back = N.parse_links(spark.read.csv(out, sep="\t", header=True, quote=""))
    assert back.filter("entity_id = 's1_003'").count() == 0
    assert spark.read.csv(out, sep="\t", header=True, quote="").count() == 3


def test_f_half(spark):
    for tp, p, t, expected in ((0, 0, 0, 1.0), (0, 1, 0, 0.0), (0, 0, 1, 0.0), (1, 1, 1, 1.0), (1, 2, 1, 5 / 9), (1, 1, 2, 5 / 6), (2, 3, 2, 0.714286)):
        got = spark.range(1).select(E.f_half(F.lit(tp), F.lit(p), F.lit(t))).first()[0]
        assert abs(got - expected) < 1e-6


def test_exclusive(spark):
    rows = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.9), ("b", "y", 0.5)], "entity_id string, target_id string, p double")
    assert {(r.entity_id, r.target_id) for r in D.exclusive_global(rows).collect()} == {("a", "x"), ("b", "y")}
    locked = rows.filter("entity_id = 'b' AND target_id = 'x'")
    assert {(r.entity_id, r.target_id) for r in D.exclusive_tiered(locked, rows).collect()} == {("b", "x"), ("b", "y")}


def test_contract(spark):
    rows = spark.createDataFrame([("S1-1", "a", None, "US"), ("S1-1", None, "b", None), ("S2-3", "c", "d", "US")], SCHEMA)
    assert E.contract(rows, "S1-").first().asDict() == {"rows": 3, "missing_ids": 0, "repeated_ids": 1, "wrong_prefix": 1, "null_names": 1, "null_countries": 1, "null_addresses": 1}


def test_null_country(spark):
    rows = B.normalize(spark.createDataFrame([("S1-1", "Apex Labs", None, None), ("S2-1", "Apex Labs", None, " ")], SCHEMA))
    q, t = rows.filter("entity_id = 'S1-1'"), rows.filter("entity_id = 'S2-1'")
    assert B.candidates(q, t).count() == 1 and B.candidates(q, t, k=None).count() == 1
    assert B.pair_space(q, t).first().n_pairs == 1


def test_three_pass(spark):
    q, t = sides(spark)
    found = {(r.entity_id, r.target_id): r.provenance for r in B.three_pass(q, t).collect()}
    assert found["s1_001", "t2_001"] == "exact_clean" and found["s1_001", "t2_002"] == "token_sorted"


def test_round_trips(spark, tmp_path):
    links = spark.createDataFrame([("a", "S2-1", 0.9), ("a", "S3-2", 0.5), ("b", "S2-1", 0.25)], "entity_id string, target_id string, p double")
    N.write_probabilities(links, str(tmp_path / "p"))
    assert sorted(map(tuple, N.read_probabilities(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, links.collect()))
    assert N.write_shards(links, str(tmp_path / "s"), 3) == [0, 1, 2] and N.write_shards(links, str(tmp_path / "s"), 3) == []
    assert N.read_shards(spark, str(tmp_path / "s")).count() == 3


def result(tmp_path, *lines):
    path = tmp_path / f"r{len(list(tmp_path.iterdir()))}.tsv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_validator(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    candidates = spark.createDataFrame([("S1-1", "S2-1")], "entity_id string, target_id string")
    targets = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    check = lambda *lines: E.validate(spark, result(tmp_path, *lines), required, candidates, targets)
    head = "source1_entity_id\tmatched_entity_ids"
    assert check(head, "S1-1\tS2-1", "S1-2\t") == ([], [])
    assert "commas" in check("source1_entity_id,matched_entity_ids", "S1-1,S2-1")[0][0]
    assert "header" in check("a\tb", "S1-1\tS2-1")[0][0]
    assert check(head, "S1-1\tS2-1", "S1-2\t", "junk")[0] == ["rows without a tab: 1"]
    assert check(head, "S1-1\tS2-1,S2-1,S1-2,X-1,S2-9", "S1-1\t", "S1-9\t") == (
        ["bad_prefix: 1", "extra_entity: 1", "missing_entity: 1", "repeated_entity: 1", "repeated_target: 1", "self_match: 1", "unknown_target: 1"], ["outside_candidates: 1"])


def test_required(spark):
    import pytest

    good = spark.createDataFrame([("S1-1", "a", None, "US")], SCHEMA)
    E.required(good, "S1-")
    for bad in (good.drop("country"), good.limit(0), good.unionAll(good), good.replace("S1-1", "S2-1")):
        with pytest.raises(ValueError):
            E.required(bad, "S1-")


def test_stream(spark, tmp_path):
    """Batches run again leave the same links; a target stays with its first query."""
    from kinfold.streaming import incremental

    schema, inbox = SCHEMA, tmp_path / "in"
    targets = spark.createDataFrame(TARGETS, SCHEMA)
    links, marks = str(tmp_path / "links"), str(tmp_path / "marks")
    for k, row in enumerate([QUERIES[0], ("s1_009", *QUERIES[0][1:])]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(inbox))
        incremental.link_stream(spark.readStream.schema(schema).parquet(str(inbox)), targets, links, marks).awaitTermination()
    got = {(r.entity_id, r.target_id) for r in incremental.linked(spark, links).collect()}
    assert ("s1_001", "t2_001") in got and not any(e == "s1_009" and t == "t2_001" for e, t in got)


def test_command_line(spark, tmp_path, capsys):
    from kinfold.__main__ import main

    for name, rows in (("q", QUERIES), ("t", TARGETS)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.csv(str(tmp_path / name), sep="\t", header=True, quote="")
    out = str(tmp_path / "c")
    assert main(["candidates", "--source1", str(tmp_path / "q"), "--targets", str(tmp_path / "t"), "--output", out, "--top-k", "2"]) == 0
    lists = {r[0]: r[1] for r in spark.read.csv(out, sep="\t", header=True, quote="").collect()}
    assert set(lists) == {"s1_001", "s1_002", "s1_003"} and lists["s1_001"] == "t2_001,t2_002"
    spark.read.csv(out, sep="\t", header=True, quote="").withColumnRenamed("candidate_entity_ids", "matched_entity_ids").coalesce(1).write.csv(str(tmp_path / "m"), sep="\t", header=True, quote="")
    assert main(["evaluate", "--pred", str(tmp_path / "m"), "--gt", str(tmp_path / "m"), "--verbose"]) == 0
    assert "macro_f05\t1.0" in capsys.readouterr().out


def _cosines(queries, targets, least):
    """Cosines of all pairs of (id, country, name), by plain Python."""

    def counts(rows):
        out = {}
        for id_, country, name in rows:
            mine = out.setdefault(id_, Counter())
            for w in (f" {w} " for w in name.split()):
                mine.update((country, w[i : i + n]) for n in (3, 4) for i in range(len(w) - n + 1))
        return out

    q, t = counts(queries), counts(targets)
    df, total = Counter(g for x in t.values() for g in x), Counter(x[1] for x in targets)
    idf = {g: log((1 + total[g[0]]) / (1 + n)) + 1 for g, n in df.items() if n >= 2}

    def unit(x):
        w = {g: (1 + log(n)) * idf[g] for g, n in x.items() if g in idf}
        return {g: y / sqrt(sum(z * z for z in w.values())) for g, y in w.items()}

    q, t = ({k: unit(x) for k, x in side.items()} for side in (q, t))
    scores = {(a, b): round(sum(y * t[b].get(g, 0) for g, y in q[a].items()), 6) for a in q for b in t}
    return {k: x for k, x in scores.items() if x >= least}


def _searched(spark):
    words = ("apex", "añex", "granite", "gränite", "harbor", "harbour", "apexes", "tundra", "🙂apex", "b")
    name = lambda k: f"{words[k % 10]} {words[k * 7 % 9]}  {words[k // 3 % 8]}" if k % 11 else ""
    rows = [(f"{'S1' if k % 3 == 0 else 'S2'}-{k}", ("US", "DE")[k % 2], name(k)) for k in range(240)] + [("S2-1", "US", "apex harbor"), ("S1-3", "DE", "granite tundra")]
    df = spark.createDataFrame(rows, "entity_id string, country string, clean_name string")
    q, t = df.filter("entity_id LIKE 'S1%'"), df.filter("entity_id LIKE 'S2%'")
    return [x for x in rows if x[0] < "S2"], [x for x in rows if x[0] > "S2"], q, t


def test_gram_search_is_exact(spark):
    queries, targets, q, t = _searched(spark)
    expected = _cosines(queries, targets, 0.12)
    index = B.gram_index(t, max_df=None)
    got = {(r.entity_id, r.target_id): r.score for r in B.gram_search(q, index, k=None).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - x) < 2e-6 for k, x in expected.items())
    best = B.gram_search(q, index, k=3).collect()
    for a in {r.entity_id for r in best}:
        every = sorted((-s, b) for (x, b), s in got.items() if x == a)[:3]
        assert sorted((-r.score, r.target_id) for r in best if r.entity_id == a) == every
    assert B.tfidf(q.limit(0), t).count() == 0 and B.tfidf(q, t.limit(0)).count() == 0


def test_gram_search_in_blocks(spark, monkeypatch):
    """Targets in many blocks, two parts in one partition, an id that is repeated."""
    queries, targets, q, t = _searched(spark)
    idf = B.gram_index(t, max_df=None).idf.toPandas()
    index = SimpleNamespace(value=(idf["hash"].to_numpy().view("uint64"), idf["idf"].to_numpy()))
    rows = [x.withColumns({"part": F.explode(F.array(F.lit(0), F.lit(1))), "side": F.lit(k)}) for k, x in enumerate(B._named(x, "clean_name", True) for x in (q, t))]
    rows[0] = rows[0].filter("part = hash(id) & 1")
    both = rows[0].unionByName(rows[1]).withColumn("shard_hash", F.xxhash64("shard")).orderBy("part", "side", "id")
    batches = both.select(F.col("part").cast("int"), F.col("side").cast("int"), "id", "shard_hash", "text").toArrow().to_batches(max_chunksize=7)
    found = lambda: {(a, b): s for x in G.searched(index, (3, 4), 5, 0.12)(iter(batches)) for a, b, s in zip(*(c.to_pylist() for c in x.columns), strict=True)}
    whole = found()
    monkeypatch.setattr(G, "BLOCK", 9)
    assert found() == whole and {a for a, _ in whole} == {a for a, _ in _cosines(queries, targets, 0.12)}


def test_gram_search_shuffles_no_pairs(spark):
    """Names that all share their grams: what is shuffled grows with the names, not with their pairs."""
    df = spark.range(600).selectExpr("concat('S', id % 2 + 1, '-', id) AS entity_id", "'US' AS country", "concat('apex harbor ', id) AS clean_name")
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = written()
    assert B.tfidf(df.filter("entity_id LIKE 'S1%'"), df.filter("entity_id LIKE 'S2%'"), max_df=None).count() == 300 * 60
    assert sum(n for k, n in written().items() if k not in before) < 20_000


def test_models_read_stored_rows(spark, monkeypatch):
    """What a model reads in each of its steps has no join or shuffle behind it."""
    d, fitted = "/root/testdata/sf0.001", []
    rows = Q.labelled(spark, d)
    true = {(r.entity_id, r.target_id) for r in Q.truth(spark, d).collect()}
    assert {(r.entity_id, r.target_id): r.label for r in rows.collect()} == {(r.entity_id, r.target_id): int((r.entity_id, r.target_id) in true) for r in Q.top(spark, d).collect()}
    monkeypatch.setattr(M, "logistic", lambda names, n: SimpleNamespace(fit=lambda df: fitted.append(df) or None))
    monkeypatch.setattr(M, "score", lambda model, rows: rows.withColumn("p", F.lit(0.0)))
    Q.queries()["ranker_scores"](spark, d)
    for df in (rows, *fitted):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    assert len(fitted) == 1 and fitted[0].filter("label = 1").count() == fitted[0].filter("label = 0").count()


def test_ranked_pairs_both_ways(spark):
    rows = spark.createDataFrame([("q", 1, 5.0), ("q", 0, 2.0), ("q", 0, 4.0), ("r", 1, 1.0), ("s", 0, 9.0)], "entity_id string, label int, x double")
    both = M.both_ways(M.ranked_pairs(rows, ["x"]), ["x"])
    assert sorted((r.x, r.label) for r in both.collect()) == [(-3.0, 0), (-1.0, 0), (1.0, 1), (3.0, 1)]


def _folded(spark):
    """Rows of two columns and a constant one, with labels that neither tells for sure, in folds."""
    rows = [(k % 3, int((k * 7919 % 101) + 20 * (k % 5) > 90), [k * 7919 % 101 / 10, float(k % 5), 0.3]) for k in range(400)]
    return spark.createDataFrame(rows, "fold int, label int, x array<double>")


def test_logistic_of_all_folds_in_few_passes(spark, monkeypatch):
    """The optimum of the library's loss, for all folds in the same passes: the library makes a pass for each fold and step."""
    rows, passes, passed = _folded(spark).cache(), [], M._passed
    monkeypatch.setattr(M, "_passed", lambda *a: passes.append(1) or passed(*a))
    fits = M.logistic_without(rows, [0, 1, 2, -1], 400)
    assert len(passes) <= 20
    wide = rows.select("fold", "label", "x", *[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(3)])
    for at, k in enumerate([0, 1, 2, -1]):
        model = M.logistic(["x0", "x1", "x2"], 400).fit(wide.filter(F.col("fold") != k))
        both = M.score(model, wide).withColumn("q", M.logistic_score(fits, F.lit(at))).agg(F.max(F.abs(F.col("p") - F.col("q"))), F.count("q")).first()
        assert both[0] < 1e-3 and both[1] == 400


def test_logistic_of_one_kind_and_separable_labels(spark):
    import pytest

    rows = _folded(spark)
    p = lambda df, at=0: [r.p for r in df.select(M.logistic_score(M.logistic_without(df, [-1], 400), F.lit(at)).alias("p")).collect()]
    assert set(p(rows.withColumn("label", F.lit(0)))) == {0.0} and set(p(rows.withColumn("label", F.lit(1)))) == {1.0}
    apart = rows.withColumn("label", (F.get("x", F.lit(0)) > 5).cast("int"))
    assert all((x > 0.5) == (r.x[0] > 5) for x, r in zip(p(apart), apart.collect(), strict=True))
    for bad in (rows.withColumn("x", F.array(F.lit(None).cast("double"))), rows.limit(0)):
        with pytest.raises(ValueError):
            M.logistic_without(bad, [-1], 400)


def test_stacked_scores_whole(spark, monkeypatch):
    """Every candidate once, with its label; five linear models take the passes of one."""
    passes, passed = [], M._passed
    monkeypatch.setattr(M, "_passed", lambda *a: passes.append(1) or passed(*a))
    d = "/root/testdata/sf0.001"
    got = Q.queries()["stacked_scores"](spark, d)
    assert got.columns == ["entity_id", "target_id", "label", "p"] and 0 < len(passes) <= 120
    assert sorted((r.entity_id, r.target_id, r.label) for r in got.collect()) == sorted((r.entity_id, r.target_id, r.label) for r in Q.labelled(spark, d).collect())
    assert got.filter("p IS NULL OR isnan(p) OR p < 0 OR p > 1").count() == 0
