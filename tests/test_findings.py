"""Anomalies, drift, schema, scores, graphs and forecasts with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.functions import scores
from relyframe.operators import anomaly, density, drift, graph, schema
from relyframe.operators.density import local_outlier_factor, lof_anomalies
from relyframe.operators.forest import isolation_forest
from relyframe.plans import governance, insight, trends
from relyframe.session import settle

SPIKE = [10.0, 10.1, 10.2, 9.9, 9.8, 10.0, 10.1, 10.0, 9.9, 20.0]


def numbered(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"row int, col1 {kind}").withColumn("row", F.col("row").cast("string"))


def test_zscore_and_iqr_find_the_spike(spark):
    df = numbered(spark, SPIKE)
    assert [r.row for r in anomaly.zscore_anomalies(df, [], ["row"], 2.0).collect()] == ["9"]
    assert [r.row for r in anomaly.iqr_anomalies(df, [], ["row"]).collect()] == ["9"]


def test_no_spread_no_anomaly(spark):
    df = numbered(spark, [5.0] * 5)
    assert anomaly.zscore_anomalies(df, [], ["row"]).count() == 0
    assert anomaly.iqr_anomalies(df, [], ["row"]).count() == 0


def cloud(spark, extra, n=100):
    rng = np.random.default_rng(42)
    pts = np.vstack([rng.normal(10, 1, (n, 2)), extra])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "row int, a double, b double"), pts


def test_isolation_forest_finds_a_planted_row(spark):
    df, _ = cloud(spark, [[25, 25], [-10, -10]])
    found = isolation_forest(df, ["row"], ["a", "b"], 0.03).collect()
    assert {r.row for r in found} & {100, 101}
    assert len(found) <= 4 and all(r.score > 0 for r in found)
    again = isolation_forest(df, ["row"], ["a", "b"], 0.03).collect()
    assert {r.row for r in found} == {r.row for r in again}


def test_lof_finds_the_planted_row(spark):
    df, _ = cloud(spark, [[25, 25]])
    assert 100 in {r.row for r in lof_anomalies(df, ["row"], ["a", "b"], 0.03).collect()}


def test_model_detectors_need_five_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "row int, a double")
    assert isolation_forest(df, ["row"], ["a"]).count() == 0
    assert lof_anomalies(df, ["row"], ["a"]).count() == 0


def brute_lof(x, k):
    """Equal points are told apart by position; ties at the k-th distance go by coordinates."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    rank = np.empty(n, dtype=int)
    rank[np.lexsort(x.T[::-1])] = np.arange(n)
    nb = np.array([np.lexsort((rank, d[i]))[:k] for i in range(n)])
    kd = np.array([d[i, nb[i, -1]] for i in range(n)])
    reach = np.array([np.maximum(kd[nb[i]], d[i, nb[i]]) for i in range(n)])
    lrd = 1 / (reach.mean(1) + 1e-10)
    return lrd[nb].mean(1) / lrd


@pytest.mark.parametrize("dims", [2, 3])
def test_lof_over_many_cells_equals_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    parts = [rng.normal(0, 1, (250, dims)), rng.normal(40, 0.2, (250, dims)), rng.uniform(-80, 80, (100, dims))]
    x = np.vstack([*parts, np.full((60, dims), 3.25)]).round(3)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "row int, " + ", ".join(f"c{j} double" for j in range(dims)))
    got = {r.row: r.lof for r in local_outlier_factor(df, ["row"], [f"c{j}" for j in range(dims)], k=20, cell=40).collect()}
    want = brute_lof(x, 20)
    assert [got[i] for i in range(len(x))] == pytest.approx(want.tolist(), rel=1e-6)


def test_lof_cells_get_each_outside_point_once(spark):
    """What moves between the steps is one row per cell and outside point, not a list per point."""
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 100, (1200, 2)).round(2)
    df = spark.createDataFrame([(i, [float(a), float(b)], 1) for i, (a, b) in enumerate(sorted(map(tuple, x)))], "id bigint, x array<double>, cnt bigint")
    splits = density._split_levels(df, 2, 100)
    placed = settle(density._place(density._at_root(df), splits))
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 100
    got = density.outside_points(df, placed, splits, 2, 20, 100).collect()
    assert len({(r.home, r.id) for r in got}) == len(got)
    home = {r.id: r.cell for r in placed.collect()}
    x = np.array([r.x for r in df.orderBy("id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    nearest = np.argsort(d, axis=1, kind="stable")[:, :20]
    want = {(home[i], j) for i in range(1200) for j in nearest[i].tolist() if home[i] != home[j]}
    assert want <= {(r.home, r.id) for r in got}
    assert len(got) < 3 * len(want)


def versions(spark, base, target, kind):
    rows = [("d", 1, v) for v in base] + [("d", 2, v) for v in target]
    return spark.createDataFrame(rows, f"dataset_id string, version_number int, col1 {kind}")


def drift_of(spark, base, target, kind):
    df = versions(spark, base, target, kind)
    b = spark.createDataFrame([("d", 1)], "dataset_id string, baseline_version int")
    return {r.drift_metric: (r.drift_score, r.severity) for r in drift.calculate_drift(df, b).collect()}


def test_psi(spark):
    same = [float(i % 10 + 1) for i in range(100)]
    assert drift_of(spark, same, same, "double")["PSI"][0] < 0.05
    rng = np.random.default_rng(1)
    b, t = rng.normal(10, 1, 100), rng.normal(12, 1, 100)
    moved = drift_of(spark, b.tolist(), t.tolist(), "double")["PSI"]
    assert moved[0] == pytest.approx(numpy_psi(b, t)) and moved[0] > 0.25 and moved[1] == "HIGH"


def test_psi_of_values_wholly_outside_the_bins(spark):
    """No target value falls in a bin: smoothing alone fills them, as in the direct sum."""
    b, t = np.arange(100.0), np.arange(500.0, 600.0)
    got = drift_of(spark, b.tolist(), t.tolist(), "double")["PSI"]
    assert got[0] == pytest.approx(numpy_psi(b, t), abs=1e-12)


def numpy_psi(b, t, bins=10, eps=1e-4):
    e = np.unique(np.percentile(b, np.linspace(0, 100, bins + 1)))
    e[0], e[-1] = e[0] - 1e-5, e[-1] + 1e-5
    p, q = np.histogram(b, e)[0] / len(b) + eps, np.histogram(t, e)[0] / len(t) + eps
    p, q = p / p.sum(), q / q.sum()
    return float(((q - p) * np.log(q / p)).sum())


def test_psi_equals_direct_sum_with_repeated_edges(spark):
    rng = np.random.default_rng(5)
    b = [float(v) for v in rng.integers(0, 4, 200)] + [9.0] * 120
    t = [float(v) for v in rng.integers(-2, 12, 150)]
    assert drift_of(spark, b, t, "double")["PSI"][0] == pytest.approx(numpy_psi(np.array(b), np.array(t)))


def test_constant_baseline_has_no_psi(spark):
    got = drift_of(spark, [5.0] * 4, [5.0, 6.0], "double")
    assert got["PSI"] == (0.0, "LOW")


def test_mean_shift(spark):
    assert drift_of(spark, [10] * 5, [15] * 5, "int")["MEAN_SHIFT"] == (0.5, "HIGH")
    assert drift_of(spark, [0] * 3, [5] * 3, "int")["MEAN_SHIFT"][0] == 5.0


def test_text_drift(spark):
    got = drift_of(spark, ["A"] * 4 + ["B"] * 4, ["A"] * 7 + ["B"], "string")
    assert got["DIST_DRIFT"][0] == pytest.approx(0.375) and got["DIST_DRIFT"][1] == "HIGH"
    assert drift_of(spark, ["A", "B"], ["C", "D"], "string")["DIST_DRIFT"][0] == pytest.approx(1.0)
    assert drift_of(spark, list("ABC"), list("ABCDEF"), "string")["CARD_DRIFT"] == (1.0, "HIGH")


def test_schema_diff_and_catalog(spark):
    rows = [("d", 1, "id", "int64"), ("d", 1, "name", "object"), ("d", 2, "id_val", "int64"), ("d", 2, "age", "int64"), ("d", 3, "id_val", "float64"), ("d", 3, "age", "int64")]
    s = spark.createDataFrame(rows, "dataset_id string, version_number int, column_name string, data_type string")
    ch = schema.schema_changes(s).collect()
    assert len([c for c in ch if c.version_number == 2]) == 4
    assert [(c.change_type, c.is_breaking) for c in ch if c.version_number == 3] == [("TYPE_CHANGE", True)]
    names = "user_id email salary country phone_num first_name street_address ip revenue_amount postal_code update_time qty".split()
    cols = spark.createDataFrame([("d", n) for n in names], "dataset_id string, column_name string")
    cat = schema.semantic_catalog(cols)
    got = {r.column_name: (r.semantic_type, r.pii_class) for r in cat.collect()}
    assert got["user_id"] == ("IDENTIFIER", "NONE") and got["email"] == ("PII", "EMAIL")
    assert got["salary"][0] == got["revenue_amount"][0] == "FINANCIAL"
    assert got["country"][0] == got["postal_code"][0] == "GEOGRAPHY"
    assert [got[n][1] for n in ("phone_num", "first_name", "street_address", "ip")] == ["PHONE", "NAME", "ADDRESS", "IP"]
    assert got["update_time"][0] == "TEMPORAL" and got["qty"][0] == "QUANTITY"
    assert schema.sensitivity(cat).first().sensitivity_level == "CONFIDENTIAL"
    plain = schema.semantic_catalog(cols.where("column_name = 'qty'"))
    assert schema.sensitivity(plain).first().sensitivity_level == "PUBLIC"
    prior = spark.createDataFrame([("d", "CONFIDENTIAL")], "dataset_id string, sensitivity_level string")
    assert schema.sensitivity(plain, prior).first().sensitivity_level == "CONFIDENTIAL"


def test_type_inference(spark):
    rows = [("d", "1", "1.5", "x", "true", None), ("d", "2", "2", "3", "false", None), ("d", None, "3", "4", "true", None)]
    df = spark.createDataFrame(rows, "dataset_id string, a string, b string, c string, e string, f string")
    got = {r.column_name: r.data_type for r in schema.infer_types(df, ["dataset_id"]).collect()}
    assert got == {"a": "float64", "b": "float64", "c": "object", "e": "bool"}


@pytest.mark.parametrize("inp,score,status", [((0, 0, 0, 0), 100, "Healthy"), ((5, 5, 1, 0), 85, "Warning"), ((10, 10, 3, 0), 65, "Degraded"), ((30, 30, 10, 20), 0, "Critical")])
def test_health(spark, inp, score, status):
    df = spark.createDataFrame([tuple(map(float, inp[:2])) + inp[2:]], "missing_cells_percent double, duplicate_rows_percent double, violation_count int, anomaly_count int")
    r = scores.add_health(df).first()
    assert (r.health_score, r.status) == (score, status)


def test_reliability(spark):
    df = spark.createDataFrame([(100.0,) * 4, (10.0,) * 4], "health_score double, quality_score double, drift_score double, anomaly_score double")
    assert [(r.reliability_score, r.classification) for r in scores.add_reliability(df).collect()] == [(100.0, "excellent"), (10.0, "critical")]


def test_forecasts(spark):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate([100.0, 90.0, 80.0])] + [("e", 0, 140.0)], "k string, i int, v double")
    assert {r.k: r.forecast for r in trends.forecast(df, ["k"], "i", "v").collect()} == {"d": pytest.approx(70.0), "e": 140.0}
    assert {r.k: r.moving_average for r in trends.moving_average(df, ["k"], "i", "v", 2).collect()} == {"d": 85.0, "e": 140.0}


def test_freshness(spark):
    df = spark.sql("SELECT 1 AS dataset_no, 1 AS record_id, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS expected_time, TIMESTAMP_NTZ '2024-01-01 12:00:30' AS actual_time")
    log = governance.freshness_log(df)
    assert (log.first().delay_minutes, log.first().status) == (120, "critical")
    two = spark.createDataFrame([(1,), (2,)], "dataset_no int")
    m = {r.dataset_no: r for r in governance.freshness_metrics(log, two).collect()}
    assert (m[1].freshness_score, m[1].sla_breach) == (0.0, True)
    assert (m[2].freshness_score, m[2].sla_breach, m[2].average_delay_minutes) == (100.0, False, 0.0)


def test_cycles_in_mixed_graphs(spark):
    """Chains, branches, dead ends, loops behind branches and a loop of branching nodes, against a walk."""
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 7), (5, 4), (8, 9), (8, 6), (10, 11), (10, 12), (11, 10), (12, 10), (11, 12), (13, 10), (13, 7), (14, 13), (15, 15), (16, 17), (16, 18), (17, 19), (18, 19), (19, 20)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    nodes = {n for e in edges for n in e}

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for m in after.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    loops = {n for n in nodes if n in reach(n)}
    got = {r.node: r.meets_cycle for r in graph.meets_cycle(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {n: bool(({n} | reach(n)) & loops) for n in nodes}


def test_long_chain_needs_few_rounds(spark, monkeypatch):
    rounds = []
    plain = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: rounds.append(1) or plain(df))
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.meets_cycle(chain).where("meets_cycle").count() == 0 and len(rounds) < 20
    rounds.clear()
    ring = chain.select("src", F.when(F.col("src") == 9_999, 5_000).otherwise(F.col("dst")).alias("dst"))
    assert graph.meets_cycle(ring).where("meets_cycle").count() == 10_000 and len(rounds) < 20


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 4), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10)], "src int, dst int")
    pairs = graph.reach_all(e)
    got = {}
    for r in pairs.collect():
        got.setdefault(r.root, set()).add(r.node)
    assert got[1] == {2, 3} and got[2] == {2, 3} and got[4] == {4} and got[5] == {6, 7, 8, 9, 10}
    roots = spark.createDataFrame([(5,), (1,)], "root int")
    assert {(r.root, r.node) for r in graph.reach_from(e, roots).collect()} == {(a, b) for a in (1, 5) for b in got[a]}
    cyc = {r.node: r.meets_cycle for r in graph.meets_cycle(e).collect()}
    assert {n for n, c in cyc.items() if c} == {1, 2, 3, 4}
    nodes = spark.createDataFrame([(n,) for n in (1, 4, 9, 10, 5)], "root int")
    counts = graph.reach_counts(e)
    risk = {r.root: (r.affected, r.risk) for r in graph.impact(counts, nodes, F.lit("data_change")).collect()}
    assert risk == {1: (2, "HIGH"), 4: (0, "LOW"), 9: (1, "MEDIUM"), 10: (0, "LOW"), 5: (5, "CRITICAL")}
    asked = spark.createDataFrame([(5,), (2,)], "root int")
    met = {(r.root, r.src, r.dst) for r in graph.closure_edges(e, graph.reach_from(e, asked), asked).collect()}
    assert met == {(2, 2, 3), (2, 3, 2), *((5, n, n + 1) for n in range(5, 10))}
    one = graph.impact(counts, nodes.where("root = 9"), F.lit("schema_change")).first()
    assert (one.risk, one.affected_reports) == ("HIGH", 2)


@pytest.mark.parametrize("n,score", [(0, 0.0), (1, 65.33), (2, 78.67), (3, 92.0), (5, 92.0)])
def test_evidence_confidence(spark, n, score):
    a = spark.createDataFrame([("a",)], "analysis_id string")
    ev = spark.createDataFrame([("a", "violation")] * n, "analysis_id string, evidence_type string")
    r = insight.evidence_confidence(a, ev).first()
    assert r.confidence_score == pytest.approx(score, abs=0.01)
    assert r.status == ("REVIEW_REQUIRED" if n == 0 else "COMPLETED")


@pytest.mark.parametrize("cost,roi", [(1, 15.0), (2, 7.5), (3, 5.0), (None, 15.0)])
def test_outcome(spark, cost, roi):
    df = spark.createDataFrame([(80.0, 95.0, cost)], "before_score double, after_score double, cost_factor int")
    r = insight.outcomes(df).first()
    assert (r.improvement_pct, r.roi_score) == (18.75, roi)


@pytest.mark.parametrize("priority,hours,breached", [("critical", 5, False), ("critical", 15, True), ("medium", 24, False), ("low", 47, False), ("low", 49, True)])
def test_investigation_sla(spark, priority, hours, breached):
    df = spark.sql(f"SELECT '{priority}' AS priority, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at, TIMESTAMP_NTZ '2024-01-01 00:59:00' + INTERVAL '{hours}' HOUR AS resolved_at")
    r = insight.investigation_sla(df).first()
    assert (r.actual_hours, r.breached) == (hours, breached)


def test_cost(spark):
    c = spark.createDataFrame([(500.0,)], "cpu_ms double")
    s = spark.createDataFrame([(0.25,)], "monthly_cost double")
    r = insight.cost_rollup(c, s).first()
    assert (r.compute, r.storage, r.total) == (pytest.approx(0.05), 0.25, pytest.approx(0.3))


def test_alert_operators(spark):
    m = spark.createDataFrame([("d", 1, "health_score", 50.0)], "dataset_id string, version_number int, metric string, value double")
    ops = [(1, "<", 70.0), (2, ">", 70.0), (3, "==", 50.0), (4, ">=", 50.0), (5, "<=", 49.0), (6, "!", 0.0)]
    r = spark.createDataFrame([("d", i, "health_score", o, t) for i, o, t in ops], "dataset_id string, rule_id int, metric string, op string, threshold double")
    assert sorted(x.rule_id for x in insight.monitoring_alerts(m, r).collect()) == [1, 3, 4]


def test_certification_tiers(spark):
    d = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "dataset_id string")
    v = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "dataset_id string, version_number int")
    rep = spark.createDataFrame([("a", 1, 95.0, 95.0, 0.1), ("b", 1, 40.0, 95.0, 0.1), ("c", 1, 70.0, 70.0, 0.4)], "dataset_id string, version_number int, health_score double, quality_score double, overall_drift_score double")
    sla = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 0.0)], "dataset_id string, compliance_pct double")
    inc = spark.createDataFrame([("c", 1, 1)], "dataset_id string, version_number int, open_count int")
    got = {r.dataset_id: r.certification_level for r in governance.certification(d, v, rep, sla, inc, "2024-02-01 00:00:00").collect()}
    assert got == {"a": "platinum", "b": "bronze", "c": "silver", "e": "bronze"}


def test_isolation_forest_draws_trees_in_compiled_code(spark):
    """Each tree takes the rows of the smallest hashes among those below its threshold, and no lambda runs over the trees of every row."""
    from relyframe.operators import forest

    rows = spark.range(2_000).select(F.col("id").alias("row"), F.array(F.col("id").cast("double")).alias("x"))
    drawn = forest._sample(rows, 2_000, ["row"], 7, 50)
    assert "lambdafunction" not in drawn._jdf.queryExecution().executedPlan().toString()
    h = rows.select("x", F.xxhash64(F.lit(forest.SEED), "row", "x").alias("h"))
    want = set()
    for t in range(7):
        near = h.where(F.pmod(F.xxhash64("h", F.lit(t)), F.lit(1 << 62)) < int(0.05 * (1 << 62)))
        want |= {(t, r.x[0]) for r in near.orderBy(F.xxhash64("h", F.lit(t)), "x").limit(50).collect()}
    assert {(r.tree, r.x[0]) for r in drawn.collect()} == want
