"""Readers: table by name, format dispatch, CSV with missing-value tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relyframe.operators.profile import named

# Text that a CSV reader takes as a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# What counts as a number, as for inferred schemas.
WHOLE = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

_FORMAT_WORDS = {"csv": "csv", "json": "json", "parquet": "parquet", "orc": "orc"}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def blank_na(df: DataFrame) -> DataFrame:
    """Missing-value tokens in string columns become NULL."""
    return df.select(
        *[
            F.when(~named(f.name).isin(NA_TOKENS), named(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else named(f.name)
            for f in df.schema.fields
        ]
    )


def infer_csv_types(raw: DataFrame) -> dict[str, T.DataType]:
    """Types of blanked text columns from all their values: bigint, double, boolean or string.

    A whole number beyond a bigint makes the column a double; a column without
    values stays text.
    """
    long_max = 2**63
    number = lambda c: named(c).rlike(NUMBER)
    whole = lambda c: named(c).rlike(WHOLE) & named(c).try_cast("decimal(38,0)").between(-long_max, long_max - 1)
    checks = {"whole": whole, "number": number, "truth": lambda c: F.lower(named(c)).isin("true", "false")}
    names = raw.columns
    if not names:
        return {}
    found = raw.agg(*[
        F.struct(F.count(named(c)).alias("n"), *[F.count_if(named(c).isNotNull() & check(c)).alias(k) for k, check in checks.items()]).alias(f"c{i}")
        for i, c in enumerate(names)
    ]).first()
    kinds = (("whole", T.LongType()), ("number", T.DoubleType()), ("truth", T.BooleanType()))
    return {c: next((t for k, t in kinds if f["n"] and f[k] == f["n"]), T.StringType()) for c, f in zip(names, found, strict=True)}


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = False, bad_cells: str | None = None
) -> DataFrame:
    """CSV with a header; columns are taken by their name in it.

    All fields are read as text, missing-value tokens are blanked, and only
    then types are applied: those of the schema, or those found in one more
    pass over all values. A column of the schema that the header lacks is an
    error; further columns are left out. A cell that does not fit its type is
    NULL; ``bad_cells`` names a column that counts such cells of a row. Quoted
    line breaks need ``multi_line``, which makes one task of each file. All
    files of a path must have the same header.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).option("escape", '"')
    raw = blank_na(reader.option("multiLine", multi_line).csv(path))
    if schema is None:
        want = infer_csv_types(raw)
    else:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        want = {f.name: f.dataType for f in fields}
    missing = [c for c in want if c not in raw.columns]
    if missing:
        raise ValueError(f"the header of {path} has no column {', '.join(missing)}")
    typed = {c: named(c).try_cast(t) for c, t in want.items()}
    out = [v.alias(c) for c, v in typed.items()]
    if bad_cells:
        out.append(sum((F.when(named(c).isNotNull() & v.isNull(), 1).otherwise(0) for c, v in typed.items()), F.lit(0)).alias(bad_cells))
    return raw.select(*out)


def format_of(path: str, mime_type: str | None = None) -> str:
    """Choose a reader from the mime type, else the file ending; what is neither is an error."""
    for probe in (mime_type or "", path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2]):
        for word, fmt in _FORMAT_WORDS.items():
            if word in probe.lower():
                return fmt
    raise ValueError(f"no reader for {path}" + (f" ({mime_type})" if mime_type else ""))


def load_table(
    spark: SparkSession, path: str, mime_type: str | None = None, schema: str | T.StructType | None = None, **csv_options
) -> DataFrame:
    fmt = format_of(path, mime_type)
    if fmt == "csv":
        return read_csv(spark, path, schema, **csv_options)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)
