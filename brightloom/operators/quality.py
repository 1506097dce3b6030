"""Column contracts: checks, validation report, quarantine."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

_REPORT = "column_name string, check_name string, passed boolean, detail string"


@dataclass(frozen=True)
class ColumnRule:
    """Contract of one column. ``kind`` is numeric, integer or categorical."""

    name: str
    kind: str
    min_value: float | None = None
    max_value: float | None = None
    max_null_fraction: float = 0.0
    allowed_values: tuple[str, ...] | None = None


class ContractBroken(ValueError):
    """Raised by ``require_valid``."""


def contract_json(name: str, rules: Sequence[ColumnRule]) -> str:
    return json.dumps({"name": name, "columns": [asdict(r) for r in rules]}, sort_keys=True)


def contract_hash(name: str, rules: Sequence[ColumnRule]) -> str:
    """First 16 hex digits of SHA-256 over the sorted JSON of the contract."""
    return hashlib.sha256(contract_json(name, rules).encode()).hexdigest()[:16]


def _kind_ok(kind: str, data_type: T.DataType) -> bool:
    integral = isinstance(data_type, T.IntegralType)
    if kind == "integer":
        return integral
    if kind == "numeric":
        return isinstance(data_type, T.NumericType)
    return integral or isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def schema_checks(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Presence and type family, from the schema alone. A missing column has no other check."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for r in rules:
        if r.name not in types:
            rows.append((r.name, "presence", False, "column missing"))
            continue
        ok = _kind_ok(r.kind, types[r.name])
        rows.append((r.name, "dtype", ok, "" if ok else f"expected {r.kind}, got {types[r.name].simpleString()}"))
    return df.sparkSession.createDataFrame(rows, _REPORT)


def _present(df: DataFrame, rules: Sequence[ColumnRule]) -> list[ColumnRule]:
    return [r for r in rules if r.name in df.columns]


def _outside(rule: ColumnRule) -> Column:
    c = F.col(rule.name)
    bad = F.lit(False)
    if rule.min_value is not None:
        bad = bad | (c < rule.min_value)
    if rule.max_value is not None:
        bad = bad | (c > rule.max_value)
    return bad


def _bounds(rule: ColumnRule) -> str:
    low = "-inf" if rule.min_value is None else str(float(rule.min_value))
    high = "inf" if rule.max_value is None else str(float(rule.max_value))
    return f"[{low}, {high}]"


def _has_range(rule: ColumnRule) -> bool:
    return rule.min_value is not None or rule.max_value is not None


def value_checks(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Null fractions and ranges of all columns in one aggregate over one scan.

    Rows: (column_name, check_name, measured, allowed, passed, detail).
    """
    here = _present(df, rules)
    ranged = [r for r in here if _has_range(r)]
    wide = df.agg(
        *[F.avg(F.col(r.name).isNull().cast("double")).alias(f"null_{r.name}") for r in here],
        *[F.count_if(_outside(r)).cast("double").alias(f"bad_{r.name}") for r in ranged],
    )

    def cell(rule: ColumnRule, check: str, measured: Column, allowed: float, ok: Column, note: Column) -> Column:
        return F.struct(
            F.lit(rule.name).alias("column_name"), F.lit(check).alias("check_name"), measured.alias("measured"),
            F.lit(float(allowed)).alias("allowed"), ok.alias("passed"), F.when(ok, "").otherwise(note).alias("detail"),
        )

    cells = []
    for r in here:
        part = F.coalesce(F.col(f"null_{r.name}"), F.lit(0.0))
        note = F.format_string(f"%.3f > allowed {r.max_null_fraction:.3f}", part)
        cells.append(cell(r, "null_fraction", part, r.max_null_fraction, part <= r.max_null_fraction, note))
    for r in ranged:
        bad = F.col(f"bad_{r.name}")
        note = F.concat(bad.cast("long").cast("string"), F.lit(f" values outside {_bounds(r)}"))
        cells.append(cell(r, "range", bad, 0.0, bad == 0, note))
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def domain_counts(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Occurring values of the restricted columns with ``allowed``: (column_name, value, n, allowed)."""
    limited = [r for r in _present(df, rules) if r.allowed_values is not None]
    cells = [
        F.struct(
            F.lit(r.name).alias("column_name"), F.col(r.name).cast("string").alias("value"),
            F.col(r.name).cast("string").isin(*r.allowed_values).alias("allowed"),
        )
        for r in limited
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("value").isNotNull())
        .groupBy("column_name", "value", "allowed").agg(F.count(F.lit(1)).alias("n"))
    )


def domain_violations(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Every unexpected value as a row, so a column full of them stays distributed."""
    return domain_counts(df, rules).where(~F.col("allowed")).select("column_name", "value", "n")


def domain_checks(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    limited = [r for r in _present(df, rules) if r.allowed_values is not None]
    found = domain_counts(df, rules).groupBy("column_name").agg(
        F.count_if(~F.col("allowed")).alias("unexpected_values"),
        F.coalesce(F.sum(F.when(~F.col("allowed"), F.col("n"))), F.lit(0)).alias("unexpected_rows"),
    )
    every = df.sparkSession.createDataFrame([(r.name,) for r in limited], "column_name string")
    return every.join(found, "column_name", "left").select(
        "column_name",
        F.coalesce("unexpected_values", F.lit(0)).alias("unexpected_values"),
        F.coalesce("unexpected_rows", F.lit(0)).alias("unexpected_rows"),
        (F.coalesce("unexpected_values", F.lit(0)) == 0).alias("passed"),
    )


def validation_report(df: DataFrame, name: str, rules: Sequence[ColumnRule]) -> DataFrame:
    """All checks as rows plus the contract hash: schema only, one wide aggregate, one value count."""
    columns = ("column_name", "check_name", "passed", "detail")
    report = schema_checks(df, rules).unionByName(value_checks(df, rules).select(*columns))
    if any(r.allowed_values is not None for r in _present(df, rules)):
        note = F.concat(F.col("unexpected_values").cast("string"), F.lit(" unexpected values in "), F.col("unexpected_rows").cast("string"), F.lit(" rows"))
        domain = domain_checks(df, rules).select(
            "column_name", F.lit("category_domain").alias("check_name"), "passed",
            F.when(F.col("passed"), "").otherwise(note).alias("detail"),
        )
        report = report.unionByName(domain)
    return report.withColumn("schema_hash", F.lit(contract_hash(name, rules)))


def require_valid(report: DataFrame) -> None:
    """Gate: raise with every failed check (a report has a few rows per column)."""
    failed = report.where(~F.col("passed")).orderBy("column_name", "check_name").collect()
    if failed:
        raise ContractBroken("; ".join(f"{r['column_name']}/{r['check_name']}: {r['detail']}" for r in failed))


def with_reasons(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Adds ``reasons``: names of the constraints a row breaks (null counts unless nulls are allowed)."""
    checks = []
    for r in rules:
        c = F.col(r.name)
        if r.max_null_fraction == 0:
            checks.append(F.when(c.isNull(), F.lit(f"{r.name} missing")))
        if _has_range(r):
            checks.append(F.when(_outside(r), F.lit(f"{r.name} outside {_bounds(r)}")))
        if r.allowed_values is not None:
            checks.append(F.when(~c.cast("string").isin(*r.allowed_values), F.lit(f"{r.name} unexpected")))
    return df.withColumn("reasons", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def quarantine(df: DataFrame, rules: Sequence[ColumnRule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reasons``); unknown extra columns are refused."""
    extra = set(df.columns) - {r.name for r in rules}
    if extra:
        raise ContractBroken(f"unexpected columns: {sorted(extra)}")
    flagged = with_reasons(df, rules)
    return flagged.where(F.size("reasons") == 0).drop("reasons"), flagged.where(F.size("reasons") > 0)
