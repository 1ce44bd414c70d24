import pytest

from relyframe.operators import detectors


@pytest.mark.parametrize(("name", "kind"), [(None, "IQR"), ("no such thing", "IQR"), ("z-score", "Z_SCORE"), ("Isolation Forest", "ISOLATION_FOREST"), ("local_outlier_factor", "LOCAL_OUTLIER_FACTOR")])
def test_one_shape_for_all_detectors(spark, name, kind):
    rows = [("d", 1, i, float(i % 7), float(i % 5), "t") for i in range(60)] + [("d", 1, 99, 500.0, -300.0, "t")]
    df = spark.createDataFrame(rows, "dataset_id string, version_number int, id long, a double, b double, note string")
    found = detectors.detect(df, ["dataset_id", "version_number"], ["id"], name)
    assert found.columns == ["dataset_id", "version_number", "id", "column_name", "anomaly_type", "score", "details"]
    got = [r for r in found.collect() if r.id == 99]
    assert got and {r.anomaly_type for r in got} == {kind} and {c for r in got for c in r.column_name.split(",")} >= {"a", "b"}
    assert {v for r in got for v in r.details.values()} >= {500.0, -300.0}
