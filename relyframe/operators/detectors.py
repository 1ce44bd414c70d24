"""The four outlier detectors by name, with one row shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.operators.anomaly import iqr_anomalies, zscore_anomalies
from relyframe.operators.density import lof_anomalies
from relyframe.operators.forest import isolation_forest
from relyframe.operators.profile import numeric_columns

DEFAULT = "IQR"
# The detectors that look at one column, and those that look at all numeric columns of a row together.
BY_COLUMN = {"IQR": iqr_anomalies, "Z_SCORE": zscore_anomalies}
BY_ROW = {"ISOLATION_FOREST": isolation_forest, "LOCAL_OUTLIER_FACTOR": lof_anomalies}


def known(method: str | None) -> str:
    """The detector meant by a name in any spelling of case, blanks and hyphens; the default one for no or an unknown name."""
    name = (method or "").strip().upper().replace("-", "_").replace(" ", "_")
    return name if name in BY_COLUMN | BY_ROW else DEFAULT


def detect(df: DataFrame, keys: list[str], row_key: list[str], method: str | None = None) -> DataFrame:
    """Rows (keys, row_key, column_name, anomaly_type, score, details) of the outliers that a detector finds.

    ``details`` holds the numbers behind the finding by name: the value and the
    group's figures, or all values of the row. Detectors of whole rows name
    all their columns, parted by commas, and look at the table as a whole; rows keep their keys.
    """
    name = known(method)
    out = ["column_name", "anomaly_type", "score", "details"]
    if name in BY_COLUMN:
        found = BY_COLUMN[name](df, keys, row_key)
        numbers = [c for c in found.columns if c not in {*keys, *row_key, *out}]
        details = F.map_from_arrays(F.array(*map(F.lit, numbers)), F.array(*[F.col(c).cast("double") for c in numbers]))
    else:
        cols = [c for c in numeric_columns(df, keys) if c not in row_key]
        found = BY_ROW[name](df, [*keys, *row_key], cols).withColumn("column_name", F.lit(",".join(cols)))
        details = F.map_from_arrays(F.array(*map(F.lit, cols)), F.col("x"))
    return found.withColumn("details", details).select(*keys, *row_key, *out)
