"""Contract validation and unification of raw frames.

Raw frames hold text. Everything counted about a frame comes from one aggregate, whatever the number of columns.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.coerce import SPARK_TYPES, coerce, is_invalid
from shelfscope.sources.contracts import InputContract, Profile, normal_name

PASS, WARN, FAIL, SKIPPED = "PASS", "WARN", "FAIL", "SKIPPED"
CHECKS = ("format", "file_size", "row_limit", "required_columns", "types", "extra_columns")


def rename_plan(columns: list[str], profile: Profile) -> dict[str, str]:
    """Raw header -> canonical name. When two headers mean the same column the first keeps it."""
    aliases, plan, taken = profile.aliases(), {}, set()
    for raw in columns:
        canonical = aliases.get(normal_name(raw))
        if canonical and canonical not in taken:
            plan[raw] = canonical
            taken.add(canonical)
    return plan


def with_canonical_names(df: DataFrame, profile: Profile) -> DataFrame:
    return df.withColumnsRenamed(rename_plan(df.columns, profile))


def extra_columns(df: DataFrame, profile: Profile) -> list[str]:
    known = set(profile.dtypes)
    return [c for c in df.columns if normal_name(c) not in known]


def mismatch_counts(df: DataFrame, profile: Profile) -> DataFrame:
    """Present but unreadable values per contract column that the frame has (canonical names)."""
    present = [c for c in profile.columns if c.name in df.columns]
    counted = df.agg(
        F.count("*").alias("rows__"), *[F.count_if(is_invalid(F.col(c.name), c.dtype)).alias(c.name) for c in present]
    )
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c.name).alias("column_name"),
                        F.lit(c.dtype).alias("expected_dtype"),
                        F.col("rows__").alias("row_count"),
                        F.col(c.name).alias("mismatches"),
                    )
                    for c in present
                ]
            )
        )
    )


def unified(df: DataFrame, contract: InputContract, profile_name: str) -> DataFrame:
    """Canonical columns in contract order and type, then the extra columns unless these are dropped."""
    profile = contract.profile(profile_name)
    df = with_canonical_names(df, profile)
    dtypes = profile.dtypes

    def column(name: str) -> Column:
        dtype = dtypes.get(name, "string")
        if name not in df.columns:
            return F.lit(None).cast(SPARK_TYPES[dtype]).alias(name)
        raw = F.col(name)
        keep_raw = dtype != "string" and not contract.null_on_coercion_error
        return raw.alias(name) if keep_raw else coerce(raw, dtype).alias(name)

    extras = [] if contract.drop_unknown_columns else extra_columns(df, profile)
    return df.select(*[column(n) for n in profile.order], *[F.col(f"`{c}`") for c in extras])


def coercion_stats(df: DataFrame, contract: InputContract, profile_name: str) -> DataFrame:
    """Per canonical column: values that became null and nulls afterwards."""
    profile = contract.profile(profile_name)
    df = with_canonical_names(df, profile)
    dtypes = profile.dtypes

    def stats(name: str) -> tuple[Column, Column]:
        if name not in df.columns:
            return F.lit(0).cast("long"), F.count("*")
        raw, dtype = F.col(name), dtypes.get(name, "string")
        bad = F.count_if(is_invalid(raw, dtype))
        after = F.count_if(coerce(raw, dtype).isNull()) if contract.null_on_coercion_error else F.count_if(raw.isNull())
        return bad, after

    aggregates = []
    for name in profile.order:
        bad, after = stats(name)
        aggregates += [bad.alias(f"{name}__bad"), after.alias(f"{name}__null")]
    counted = df.agg(*aggregates, F.count("*").alias("rows__"))
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("column_name"),
                        F.lit(dtypes.get(n, "string")).alias("expected_dtype"),
                        F.col(f"{n}__bad").alias("invalid_to_null"),
                        F.col(f"{n}__null").alias("null_count_after"),
                        F.col("rows__").alias("row_count"),
                    )
                    for n in profile.order
                ]
            )
        )
    )


def worst(statuses) -> str:
    statuses = list(statuses)
    return FAIL if FAIL in statuses else WARN if WARN in statuses else PASS


def blank_report(contract: InputContract, profile_name: str) -> dict[str, Any]:
    return {
        "status": PASS,
        "contract_version": contract.version,
        "profile": profile_name,
        "checks": {name: PASS for name in CHECKS},
        "errors": [],
        "warnings": [],
        "metadata": {"rows": 0, "mapped_columns": [], "renamed_columns": {}, "extra_columns": [], "type_mismatches": {}},
    }


def validate_frame(df: DataFrame, contract: InputContract, profile_name: str) -> dict[str, Any]:
    """Validation report of a raw frame; one action, whose counts serve the unification manifest as well."""
    profile = contract.profile(profile_name)
    report = blank_report(contract, profile_name)
    checks, meta = report["checks"], report["metadata"]

    def note(check: str, status: str, message: str) -> None:
        checks[check] = worst([checks[check], status])
        report["errors" if status == FAIL else "warnings"].append(message)

    plan = rename_plan(df.columns, profile)
    named = df.withColumnsRenamed(plan)
    meta["mapped_columns"] = sorted(set(plan.values()))
    meta["renamed_columns"] = {raw: name for raw, name in plan.items() if raw != name}

    stats = coercion_stats(df, contract, profile_name).collect()
    meta["rows"] = stats[0]["row_count"]
    meta["type_mismatches"] = {r["column_name"]: r["invalid_to_null"] for r in stats if r["column_name"] in named.columns}
    meta["coercion_stats"] = {
        r["column_name"]: {k: r[k] for k in ("expected_dtype", "invalid_to_null", "null_count_after")} for r in stats
    }

    if meta["rows"] == 0:
        note("required_columns", FAIL, "CSV file is empty")
    if contract.max_rows is not None and meta["rows"] > contract.max_rows:
        note("row_limit", FAIL, f"Row count {meta['rows']} exceeds max_rows={contract.max_rows}")
    missing = sorted(set(profile.required) - {normal_name(c) for c in named.columns})
    if missing:
        note("required_columns", FAIL, f"Missing required columns: {missing}")
    meta["extra_columns"] = sorted(extra_columns(named, profile))
    if meta["extra_columns"]:
        level = WARN if contract.allow_extra_columns else FAIL
        note("extra_columns", level, f"Extra columns: {meta['extra_columns']}")
    mismatches = sum(meta["type_mismatches"].values())
    if mismatches:
        note("types", FAIL if contract.strict_types else WARN, f"Type mismatches detected: {mismatches} values")
    report["status"] = worst(checks.values())
    return report


def unify_frame(
    df: DataFrame, contract: InputContract, profile_name: str, report: dict[str, Any], source_file_name: str = ""
) -> tuple[DataFrame, dict[str, Any]]:
    """Unified frame with its manifest; a frame that failed validation is refused."""
    if report["status"] == FAIL:
        raise ValueError("Cannot unify dataset with FAIL validation status")
    profile = contract.profile(profile_name)
    out = unified(df, contract, profile_name)
    extras = extra_columns(with_canonical_names(df, profile), profile)
    manifest = {
        "source_file_name": source_file_name,
        "contract_version": contract.version,
        "profile": profile_name,
        "validation_status": report["status"],
        "renamed_columns": report["metadata"]["renamed_columns"],
        "extra_columns_dropped": extras if contract.drop_unknown_columns else [],
        "retained_extra_columns": [] if contract.drop_unknown_columns else extras,
        "coercion_stats": report["metadata"]["coercion_stats"],
        "output_row_count": report["metadata"]["rows"],
        "output_column_count": len(out.columns),
        "final_canonical_columns": list(profile.order),
    }
    return out, manifest
