"""Quality rules: metrics are computed once, rules are joined to them as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.operators.profile import column_stats, distinct_counts, percent, table_summary, value_columns

# Named patterns accepted in COLUMN_REGEX rules.
PRESET_PATTERNS = {
    "EMAIL": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "PHONE": r"^\+?[1-9]\d{1,14}$",
    "ZIPCODE": r"^\d{5}(-\d{4})?$",
}

RULE_SCHEMA = "rule_id int, rule_name string, rule_type string, threshold double, enabled boolean"
VIOLATION_COLUMNS = ["rule_id", "severity", "column_name", "actual_value", "expected_value", "message"]


def rules_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULE_SCHEMA)


def severity_from_name(name: Column) -> Column:
    """CRITICAL, HIGH or MEDIUM in the rule's name, in that order; else low."""
    up = F.upper(name)
    out = F.lit("low")
    for word in ("MEDIUM", "HIGH", "CRITICAL"):
        out = F.when(up.contains(word), F.lit(word.lower())).otherwise(out)
    return out


def anchored(pattern: str) -> str:
    """A pattern that has to match from the first character on."""
    return f"^(?:{pattern})"


def preset(pattern: str) -> str:
    return PRESET_PATTERNS.get(pattern.upper(), pattern)


def each_rule(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """Every row of ``df`` (one per group) once per rule; the rule list is fixed."""
    names = ["rule_id", "rule_name", "rule_type", "threshold", "enabled"]
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rules]
    return df.select("*", F.explode(F.array(*rows)).alias("_r")).select(*df.columns, "_r.*")


def split_rules(rules: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rule text to fields: kind, column, pattern, and target table and column."""
    head = F.split("rule_type", ":", 2)
    rest = F.coalesce(F.get(head, F.lit(1)), F.lit(""))
    kind = F.upper(F.get(head, F.lit(0)))
    is_ref, is_regex = kind == "REFERENTIAL", kind == "COLUMN_REGEX"
    column = F.when(is_ref, F.regexp_extract(rest, r"^(.*?)->", 1)).when(is_regex, F.substring_index(rest, ":", 1))
    target = F.regexp_extract(rest, r"^.*?->(.*)$", 1)
    return rules.where("enabled").select(
        *(keep or []),
        "rule_id",
        "rule_name",
        "rule_type",
        "threshold",
        severity_from_name(F.col("rule_name")).alias("severity"),
        kind.alias("kind"),
        F.nullif(F.coalesce(column, rest), F.lit("")).alias("column_name"),
        F.when(is_regex, F.regexp_extract(rest, r"^[^:]*:(.*)$", 1)).alias("pattern"),
        F.when(is_ref, F.nullif(F.substring_index(target, ":", 1), F.lit(""))).alias("target_table"),
        F.when(is_ref, F.nullif(F.regexp_extract(target, r"^[^:]*:(.*)$", 1), F.lit(""))).alias("target_column"),
    )


def missing_key_rates(source: DataFrame, keys: list[str], column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Share of distinct source keys absent from the target, per group."""
    # Distinct first: a hot key is one row before it reaches the join.
    src = source.select(*keys, F.col(column).alias("_k")).where("_k IS NOT NULL").distinct()
    tgt = target.select(F.col(target_column).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_hit", F.lit(1))
    return (
        src.join(tgt, "_k", "left")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("source_keys"), F.count_if(F.col("_hit").isNull()).alias("missing_keys"))
        .withColumn("missing_pct", percent(F.col("missing_keys"), F.col("source_keys")))
    )


def regex_rates(df: DataFrame, keys: list[str], checks: list[tuple[str, str]]) -> DataFrame:
    """Non-matching share of the non-null values for each (column, pattern): one pass."""
    aggs = []
    for i, (c, p) in enumerate(checks):
        text = F.col(c).cast("string")
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(~text.rlike(anchored(preset(p)))).alias(f"f{i}")]
    wide = df.groupBy(*keys).agg(*aggs)
    each = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(p).alias("pattern"),
                F.col(f"f{i}").alias("fail_count"),
                percent(F.col(f"f{i}"), F.col(f"n{i}")).alias("fail_pct"),
            )
            for i, (c, p) in enumerate(checks)
        ]
    )
    return wide.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")


def uniqueness_rates(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Repeated share and distinct share of the non-null values of each column."""
    stats = column_stats(df.select(*keys, *cols), keys)
    d = distinct_counts(df, keys, cols)
    filled = F.col("row_count") - F.col("missing_count")
    unique = F.coalesce(F.col("unique_count"), F.lit(0))
    return stats.join(d, [*keys, "column_name"], "left").select(
        *keys,
        "column_name",
        filled.alias("filled"),
        percent(filled - unique, filled).alias("repeat_pct"),
        percent(unique, filled).alias("unique_pct"),
    )


def metric_rows(
    df: DataFrame,
    keys: list[str],
    rules: list[tuple],
    targets: dict[str, DataFrame] | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Every figure the rules need: keys, kind, column, detail, actual value.

    ``rules`` is the rule list itself; it only decides which metrics to
    compute. Thresholds are applied later, by a join.
    """
    used = [r[2].split(":", 2) for r in rules if r[4]]
    kinds = {u[0].upper() for u in used}
    present = set(value_columns(df, keys))
    none = F.lit(None).cast("string")
    out = []

    def shape(frame, kind, column, detail, actual):
        return frame.select(
            *keys, F.lit(kind).alias("kind"), column.alias("column_name"), detail.alias("detail"), actual.cast("double").alias("actual_value")
        )

    if kinds & {"NULL_PERCENT", "DUPLICATE_PERCENT"}:
        s = table_summary(df, keys) if summary is None else summary
        pair = F.array(
            F.struct(F.lit("NULL_PERCENT").alias("kind"), F.col("missing_cells_percent").alias("a")),
            F.struct(F.lit("DUPLICATE_PERCENT").alias("kind"), F.col("duplicate_rows_percent").alias("a")),
        )
        s = s.select(*keys, F.explode(pair).alias("e"))
        out.append(s.select(*keys, "e.kind", none.alias("column_name"), none.alias("detail"), F.col("e.a").alias("actual_value")))
    stat_of = {"COLUMN_NULL_PERCENT": "missing_percent", "COLUMN_MIN": "min", "COLUMN_MAX": "max"}
    asked = {u[1] for u in used if u[0].upper() in stat_of and u[1] in present}
    if asked:
        st = column_stats(df.select(*keys, *sorted(asked)), keys)
        trio = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("a")) for k, c in stat_of.items()])
        st = st.select(*keys, "column_name", F.explode(trio).alias("e"))
        out.append(st.select(*keys, "e.kind", "column_name", none.alias("detail"), F.col("e.a").alias("actual_value")))
    checks = sorted({(u[1], u[2] if len(u) > 2 else "") for u in used if u[0].upper() == "COLUMN_REGEX" and u[1] in present})
    if checks:
        out.append(shape(regex_rates(df, keys, checks), "COLUMN_REGEX", F.col("column_name"), F.col("pattern"), F.col("fail_pct")))
    uniq = sorted({u[1] for u in used if u[0].upper() == "COLUMN_UNIQUE" and u[1] in present})
    if uniq:
        out.append(shape(uniqueness_rates(df, keys, uniq), "COLUMN_UNIQUE", F.col("column_name"), none, F.col("repeat_pct")))
    for r in rules:
        if not r[4] or not r[2].upper().startswith("REFERENTIAL:") or "->" not in r[2]:
            continue
        col, tgt = r[2].split(":", 1)[1].split("->", 1)
        name, _, tcol = tgt.partition(":")
        if col in present and targets and name in targets and tcol in targets[name].columns:
            rate = missing_key_rates(df, keys, col, targets[name], tcol)
            out.append(shape(rate, "REFERENTIAL", F.lit(col), F.lit(tgt), F.col("missing_pct")))
    frame = out[0]
    for o in out[1:]:
        frame = frame.unionByName(o)
    return frame


# Message formats of the rules.
_MESSAGES = {
    "NULL_PERCENT": "'Overall null percent %.2f%% exceeds threshold %.2f%%', actual_value, threshold",
    "DUPLICATE_PERCENT": "'Duplicate rows percent %.2f%% exceeds threshold %.2f%%', actual_value, threshold",
    "COLUMN_NULL_PERCENT": "'Column \\'%s\\' null percent %.2f%% exceeds threshold %.2f%%', column_name, actual_value, threshold",
    "COLUMN_MIN": "'Column \\'%s\\' minimum %.2f is below threshold %.2f', column_name, actual_value, threshold",
    "COLUMN_MAX": "'Column \\'%s\\' maximum %.2f exceeds threshold %.2f', column_name, actual_value, threshold",
    "COLUMN_REGEX": "'Column \\'%s\\' regex mismatch rate %.2f%% exceeds threshold %.2f%%', column_name, actual_value, threshold",
    "COLUMN_UNIQUE": "'Column \\'%s\\' uniqueness violation rate %.2f%% exceeds threshold %.2f%%', column_name, actual_value, threshold",
    "REFERENTIAL": "'Referential integrity mismatch rate %.2f%% exceeds threshold %.2f%%', actual_value, threshold",
}


def _rate_message() -> Column:
    cases = " ".join(f"WHEN '{k}' THEN format_string({m})" for k, m in _MESSAGES.items())
    return F.expr(f"CASE kind {cases} END")


def violations(
    spark: SparkSession,
    df: DataFrame,
    keys: list[str],
    rules: list[tuple],
    targets: dict[str, DataFrame] | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """One row per broken rule and group; a value equal to the limit passes.

    A rule on an absent column is a violation with empty values. Rules of an
    unknown kind are ignored here (the profile check reports them). A computed
    ``summary`` of the same groups saves the pass over whole rows.
    """
    split = F.broadcast(split_rules(rules_frame(spark, rules)))  # as many rows as there are rules
    columns = value_columns(df, keys)
    metrics = metric_rows(df, keys, rules, targets, summary)
    below = F.col("kind") == "COLUMN_MIN"
    actual, limit = F.col("actual_value"), F.col("threshold")
    detail = F.coalesce("pattern", F.concat_ws(":", "target_table", "target_column"))
    hits = (
        metrics.join(split.withColumnRenamed("column_name", "rule_column").withColumn("rule_detail", detail), "kind")
        .where(F.col("column_name").eqNullSafe(F.col("rule_column")))
        .where(F.col("detail").isNull() | (F.col("detail") == F.col("rule_detail")))
        .where(F.when(below, actual < limit).otherwise(actual > limit))
        .select(
            *keys,
            "rule_id",
            "severity",
            "column_name",
            "actual_value",
            limit.alias("expected_value"),
            _rate_message().alias("message"),
        )
    )
    on_column = F.col("kind").isin("COLUMN_NULL_PERCENT", "COLUMN_MIN", "COLUMN_MAX", "COLUMN_REGEX", "COLUMN_UNIQUE", "REFERENTIAL")
    none = F.lit(None).cast("double")
    groups = df.select(*keys).distinct() if keys else spark.range(1).select()
    gone = (
        split_rules(each_rule(groups, rules), keys)
        .where(on_column & ~F.col("column_name").isin(columns))
        .select(
            *keys,
            "rule_id",
            "severity",
            "column_name",
            none.alias("actual_value"),
            none.alias("expected_value"),
            F.when(F.col("kind") == "COLUMN_NULL_PERCENT", F.format_string("Column '%s' not found in dataset", "column_name"))
            .otherwise(F.format_string("Column '%s' not found", "column_name"))
            .alias("message"),
        )
    )
    return hits.unionByName(gone)


def check_profile(spark: SparkSession, summary: DataFrame, columns: DataFrame, keys: list[str], rules: list[tuple]) -> DataFrame:
    """Pass or fail of every enabled rule against a computed profile."""
    stats = columns.select(*keys, F.col("column_name").alias("_c"), "missing_percent", "is_numeric", "min", "max")
    summary = summary.select(*keys, "missing_cells_percent", "duplicate_rows_percent")
    base = split_rules(each_rule(summary, rules), summary.columns)
    joined = base.join(stats.withColumnRenamed("_c", "column_name"), [*keys, "column_name"], "left")
    kind, limit, col = F.col("kind"), F.col("threshold"), F.col("column_name")
    found = F.col("is_numeric").isNotNull()
    ranged = kind.isin("COLUMN_MIN", "COLUMN_MAX")
    actual = (
        F.when(kind == "NULL_PERCENT", F.col("missing_cells_percent"))
        .when(kind == "DUPLICATE_PERCENT", F.col("duplicate_rows_percent"))
        .when(kind == "COLUMN_NULL_PERCENT", F.col("missing_percent"))
        .when((kind == "COLUMN_MIN") & F.col("is_numeric"), F.col("min"))
        .when((kind == "COLUMN_MAX") & F.col("is_numeric"), F.col("max"))
    )
    known = kind.isin("NULL_PERCENT", "DUPLICATE_PERCENT", "COLUMN_NULL_PERCENT", "COLUMN_MIN", "COLUMN_MAX")
    past = F.coalesce(F.when(kind == "COLUMN_MIN", F.col("a") < limit).otherwise(F.col("a") > limit), F.lit(False))
    error = (
        F.when(~known, F.concat(F.lit("Unsupported rule type: "), F.col("rule_type")))
        .when((ranged | (kind == "COLUMN_NULL_PERCENT")) & ~found, F.format_string("Column '%s' not found in dataset", col))
        .when(ranged & ~F.col("is_numeric"), F.format_string("Column '%s' is not numeric", col))
        .when(past & (kind == "NULL_PERCENT"), F.format_string("Overall null percent %.2f%% exceeds threshold %.2f%%", "a", limit))
        .when(past & (kind == "DUPLICATE_PERCENT"), F.format_string("Duplicate rows percent %.2f%% exceeds threshold %.2f%%", "a", limit))
        .when(past & (kind == "COLUMN_NULL_PERCENT"), F.format_string("Column '%s' null percent %.2f%% exceeds threshold %.2f%%", col, "a", limit))
        .when(past & (kind == "COLUMN_MIN"), F.format_string("Column '%s' min value %.2f is below threshold %.2f", col, "a", limit))
        .when(past & (kind == "COLUMN_MAX"), F.format_string("Column '%s' max value %.2f is above threshold %.2f", col, "a", limit))
        .otherwise(F.lit(""))
    )
    return joined.withColumn("a", actual).select(
        *keys, "rule_id", "rule_name", "rule_type", "threshold", F.col("a").alias("actual_value"),
        (error == "").alias("passed"), error.alias("error_message"),
    )
