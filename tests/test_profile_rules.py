"""Profiles, quality rules and contracts on small tables with known answers."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from relyframe.operators import contracts, profile, quality, quantiles
from relyframe.operators.anomaly import iqr_anomalies
from relyframe.operators.quantiles import exact_quantiles, previous_in_groups, rank_in_groups
from relyframe.operators.relational import share_of_total


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_numeric_profile(spark):
    """Worked out by hand: sorted 2 2 4 6 8 10 12 90, so quartiles 3.5 and 10.5, fence -7 to 21."""
    df = spark.createDataFrame([(v,) for v in (12.0, 2.0, None, 90.0, 6.0, 2.0, 8.0, None, 4.0, 10.0)], "weight double")
    r = one(profile.profile(df, []))
    assert (r.row_count, r.missing_count, r.unique_count) == (10, 2, 7)
    assert (r["min"], r["max"], r["median"], r.outlier_count) == (2.0, 90.0, 7.0, 1)
    assert (r.p25, r.p75) == (3.5, 10.5)


def test_text_profile(spark):
    df = spark.createDataFrame([(v,) for v in ("oak", None, "elm", "oak", None, "ash", "oak", "elm", "yew")], "tree string")
    r = one(profile.profile(df, []))
    assert (r.missing_count, r.unique_count) == (2, 4)
    assert r.top_values == "oak=3|elm=2|ash=1|yew=1"


def test_all_null_and_single_value(spark):
    r = one(profile.profile(spark.createDataFrame([(None,)] * 5, "blank double"), []))
    assert r["min"] is None and r["std"] is None and r.outlier_count == 0
    r = one(profile.profile(spark.createDataFrame([(-3.25,)], "lone double"), []))
    assert r["std"] == 0.0 and r["median"] == -3.25


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    r = one(profile.column_stats(df, []))
    assert r.missing_count == 2 and r["max"] == 1.0


def test_duplicates(spark):
    codes = spark.createDataFrame([(v,) for v in (4, 9, 4, 4, 7, 9, 4)], "code int")
    assert one(profile.table_summary(codes, [])).duplicate_rows_count == 4
    apart = spark.createDataFrame([(4, "p"), (4, "q"), (4, "r")], "code int, tag string")
    assert one(profile.table_summary(apart, [])).duplicate_rows_count == 0
    nulls = spark.createDataFrame([(None, 5), (None, 5), (6, None), (None, 5)], "a int, b int")
    assert one(profile.table_summary(nulls, [])).duplicate_rows_count == 2


def test_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([(1.0, "x", 3), (None, "x", 4)], ["a.b", "it's", "k"]).withColumnRenamed("k", "odd `one`")
    got = {r.column_name: (r.missing_count, r.unique_count) for r in profile.profile(df, []).collect()}
    assert got == {"a.b": (1, 1), "it's": (0, 1), "odd `one`": (0, 2)}


def test_empty_table_has_no_percent(spark):
    r = one(profile.table_summary(spark.createDataFrame([], "a int, b string"), []))
    assert (r.row_count, r.duplicate_rows_percent, r.missing_cells_percent) == (0, 0.0, 0.0)


def test_no_outliers(spark):
    df = spark.createDataFrame([(v,) for v in (50.2, 49.7, 50.0, 50.1, 49.9, 50.3, 49.8)], "volt double")
    assert one(profile.outlier_counts(df, [], ["volt"])).outlier_count == 0


@pytest.mark.parametrize("probs", [[0.25, 0.5, 0.75], [i / 10 for i in range(11)], [0.05]])
def test_quantiles_with_hot_value_and_null_group(spark, probs):
    """A third of the rows share one value, one group has no key, another is tiny."""
    group = F.when(F.col("id") < 20_000, "big").when(F.col("id") < 29_990, None).otherwise("small")
    base = spark.range(30_000).select(group.alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pow(F.rand(3), 4) * 1e6).alias("v"))
    pdf = base.toPandas()
    base = spark.createDataFrame([(None if g is None else g, v) for g, v in zip(pdf.g, pdf.v)], "g string, v double")
    got = {r.g: (r.n, r.q) for r in exact_quantiles(base, ["g"], "v", probs).collect()}
    assert len(got) == 3
    for g, (n, q) in got.items():
        own = pdf[pdf.g.isna() if g is None else pdf.g == g].v
        assert n == len(own) and q == pytest.approx(own.quantile(probs).tolist())


def test_whole_table_quantiles_without_keys(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert one(exact_quantiles(df, [], "v", [0.5])).q == [500.0]
    assert exact_quantiles(df.limit(0), ["v"], "v", [0.5]).count() == 0


def test_ranks_and_previous_rows_equal_windows(spark):
    """Groups from tiny to most of the table, one without a key, over many ranges."""
    df = spark.range(5000).select("id", F.when(F.col("id") % 5 > 1, 0).when(F.col("id") % 5 == 1, None).otherwise(F.col("id") % 40).alias("g"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("s"))
    order = [F.desc("s"), F.asc("id")]
    w = Window.partitionBy("g").orderBy(*order)
    want = df.withColumns({"rank": F.row_number().over(w).cast("long"), "p": F.lag("s", 1, -1).over(w)})
    got = previous_in_groups(rank_in_groups(df, ["g"], order), ["g"], order, "s", "p", -1)
    key = lambda r: r[0]
    rows = lambda d: sorted(map(tuple, d.select("id", "g", "rank", "p").collect()), key=key)
    assert rows(got) == rows(want)


def test_null_keys_are_kept_by_joins(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 900.0), (None, 3.0), (None, 2.5), ("a", 4.0)], "g string, x double")
    assert {r.g: r.outlier_count for r in profile.outlier_counts(df, ["g"], ["x"]).collect()} == {None: 1, "a": 0}
    assert {r.g for r in iqr_anomalies(df, ["g"], ["x"]).collect()} == {None}
    assert {(r.g, r.share) for r in share_of_total(df, ["g"], "x").where("x = 4").collect()} == {("a", 1.0)} and share_of_total(df, ["g"], "x").count() == 6


def rule(kind, threshold, name="r", enabled=True):
    return (1, name, kind, float(threshold), enabled)


RULE_CASES = [
    ([8, None, None, None, 5], "int", rule("NULL_PERCENT", 55, "CRITICAL gaps"), ["critical"]),
    (["p", "q", "q", "q", "r"], "string", rule("DUPLICATE_PERCENT", 35, "HIGH repeats"), ["high"]),
    (["z", None, "z", None, None], "string", rule("COLUMN_NULL_PERCENT:c", 59, "MEDIUM share"), ["medium"]),
    ([6, 7, 8], "int", rule("COLUMN_NULL_PERCENT:nope", 15), ["low"]),
    ([-4, 0, 66], "int", rule("COLUMN_MIN:c", -3), ["low"]),
    ([-4, 0, 66], "int", rule("COLUMN_MAX:c", 65), ["low"]),
    ([2.5, 2.5, 2.5], "double", rule("COLUMN_MIN:c", 2.5), []),
    ([None, None, None], "double", rule("COLUMN_MAX:c", 1), []),
    (["kim@site.org", "kim at site", "lee@b.example", "m@n.io"], "string", rule("COLUMN_REGEX:c:EMAIL", 20), ["low"]),
    (["+4930901820", "call me", "x"], "string", rule("COLUMN_REGEX:c:PHONE", 50), ["low"]),
    (["90210", "10001-0001", "SW1A"], "string", rule("COLUMN_REGEX:c:ZIPCODE", 30), ["low"]),
    (["row:7", "row:8"], "string", rule("COLUMN_REGEX:c:row:[78]", 0), []),
    ([5, 5, 5, 6, 9], "int", rule("COLUMN_UNIQUE:c", 15), ["low"]),
    ([8, None, None], "int", rule("NULL_PERCENT", 5, "off", False), []),
    ([6, 7], "int", rule("WEIRD:c", 5), []),
]


@pytest.mark.parametrize("values,kind,r,severities", RULE_CASES)
def test_rules(spark, values, kind, r, severities):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    rules = [r, (99, "always", "NULL_PERCENT", 100.0, True)]
    got = [v for v in quality.violations(spark, df, [], rules).collect() if v.rule_id == 1]
    assert [v.severity for v in got] == severities
    if "nope" in r[2]:
        assert got[0].actual_value is None and got[0].message == "Column 'nope' not found in dataset"


def test_referential_rule(spark):
    src = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k int")
    tgt = spark.createDataFrame([(1,), (None,)], "id int")
    rules = [(1, "HIGH ref", "REFERENTIAL:k->t:id", 50.0, True)]
    r = one(quality.violations(spark, src, [], rules, {"t": tgt}))
    assert r.actual_value == pytest.approx(200 / 3) and r.severity == "high"


def test_profile_validation(spark):
    df = spark.createDataFrame([(4, "ivy"), (9, "fern"), (None, "moss"), (5, "reed")], "col1 int, col2 string")
    rules = [
        (1, "n", "COLUMN_NULL_PERCENT:col1", 10.0, True),
        (2, "d", "DUPLICATE_PERCENT", 5.0, True),
        (3, "lo", "COLUMN_MIN:col1", 4.0, True),
        (4, "hi", "COLUMN_MAX:col1", 8.5, True),
        (5, "t", "COLUMN_MIN:col2", 1.0, True),
        (6, "u", "ODD", 1.0, True),
        (7, "m", "COLUMN_MAX:zzz", 1.0, True),
        (8, "x", "NULL_PERCENT", 0.0, False),
    ]
    rows = quality.check_profile(spark, profile.table_summary(df, []), profile.column_stats(df, []), [], rules).collect()
    got = {r.rule_id: (r.passed, r.error_message) for r in rows}
    assert {k: v[0] for k, v in got.items()} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}
    assert got[5][1] == "Column 'col2' is not numeric"
    assert got[6][1] == "Unsupported rule type: ODD"
    assert got[7][1] == "Column 'zzz' not found in dataset"


def test_contract_rules(spark):
    df = spark.createDataFrame(
        [("d", 1, 11, "ada@post.example", 19, 4100), ("d", 1, 12, "max@post.example", 44, 7300)],
        "dataset_id string, version_number int, id int, email string, age int, salary int",
    )
    keys = ["dataset_id", "version_number"]
    rules = [
        (1, 7, "column_exists", "ssn", None, "critical"),
        (2, 7, "column_type", "email", "PII", "high"),
        (3, 7, "column_type", "salary", "PII", "high"),
        (4, 7, "max_null_pct", "age", None, "high"),
        (5, 7, "uniqueness", "id", None, "high"),
        (6, 7, "regex", "email", "^a", "high"),
        (7, 7, "range", "age", '{"min": 18, "max": 28}', "high"),
        (8, 7, "range", "salary", '{"min": 5500}', "high"),
        (9, 6, "column_exists", "ssn", None, "critical"),
    ]
    cons = spark.createDataFrame([(6, "d", "2024-01-01"), (7, "d", "2024-02-01")], "contract_id int, dataset_id string, created_at string")
    from relyframe.operators import schema

    types = schema.semantic_catalog(schema.declared_types(df, keys))
    rates = quality.uniqueness_rates(df, keys, ["id"])
    got = {r.rule_id: r.message for r in contracts.check_contracts(spark, df, keys, cons, rules, types, rates).collect()}
    assert sorted(got) == [1, 3, 6, 7, 8]
    assert "1 values" in got[6] and "above maximum limit of 28.00" in got[7] and "below minimum limit" in got[8]
    assert {r.contract_id: r.status for r in contracts.with_status(cons).collect()} == {6: "deprecated", 7: "active"}


def test_distinct_counts_keep_large_integers_apart(spark):
    df = spark.createDataFrame([(2**60,), (2**60 + 1,), (None,)], "a bigint").withColumn("b", F.col("a").cast("double"))
    got = {r.column_name: r.unique_count for r in profile.distinct_counts(df, [], ["a", "b"]).collect()}
    assert got == {"a": 2, "b": 1}


def test_quantiles_keep_few_values_and_count_all_rows(spark):
    """Only values around the wanted ranks leave the tasks; a hot value, overlapping brackets and small groups stay exact."""
    rng = np.random.default_rng(3)
    groups = {"wide": rng.normal(0, 1, 100_000), "hot": np.r_[np.full(9_000, 7.0), rng.uniform(0, 14, 3_000)], "few": [3.0, 1.0], "one": [5.0], None: rng.uniform(-1, 0, 500)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    probs = [0.0, 0.05, 0.25, 0.26, 0.5, 0.75, 1.0]
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs) and got[g].q == pytest.approx(np.quantile(vs, probs).tolist(), abs=1e-12)
    kept = quantiles._narrowed(df.select("g", F.col("v").alias("_v")), ["g"], [0.25, 0.5, 0.75]).where("g = 'wide'")
    assert kept.agg(F.sum("_c")).first()[0] == 100_000 and kept.count() < 30_000


def test_quantiles_outside_their_brackets_count_all_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_brackets", lambda rows, keys, probs: spark.createDataFrame([(0, [1.0, 2.0], [1.5, 2.5])], "_all int, _lo array<double>, _hi array<double>"))
    df = spark.createDataFrame([(float((7 * i) % 1000),) for i in range(1000)], "v double")
    assert quantiles.exact_quantiles(df, [], "v", [0.3, 0.9]).first().q == pytest.approx([299.7, 899.1])
