"""The older profile validation, whose checks warn, fail, drop or ignore by policy."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.coerce import coerce, is_invalid
from shelfscope.operators.validation import with_canonical_names
from shelfscope.sources.contracts import Profile, normal_name

ROW_ORDER = "_row_order"


def _range_tests(ranges: dict[str, dict], columns: list[str]) -> list[tuple[str, str, Column]]:
    """(column, kind, violation); nulls never violate a range."""
    tests = []
    for name, limits in ranges.items():
        name = normal_name(name)
        if name not in columns:
            continue
        value = F.col(name)
        for kind, bound in limits.items():
            test = {
                "allowed": lambda: ~value.isin(list(bound)),
                "min": lambda: value < bound,
                "max": lambda: value > bound,
                "min_date": lambda: value < F.lit(bound).cast("date"),
                "max_date": lambda: value > F.lit(bound).cast("date"),
            }[kind]()
            tests.append((name, kind, test))
    return tests


def keep_first(df: DataFrame, keys: list[str], order: str = ROW_ORDER) -> DataFrame:
    """The first row of every key.

    A map-side combined ``min_by`` instead of a window: a key with very many rows is reduced to one
    candidate per map task before the shuffle.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(whole, F.col(order)).alias("first")).select("first.*")


def coerced_rows(df: DataFrame, profile: Profile) -> DataFrame:
    """Canonical names and types, unknown columns kept, with the source row order."""
    named = with_canonical_names(df, profile)
    typed = [
        coerce(F.col(c), profile.dtypes[c]).alias(c) if c in profile.dtypes else F.col(f"`{c}`") for c in named.columns
    ]
    order = F.col(ROW_ORDER) if ROW_ORDER in named.columns else F.monotonically_increasing_id()
    kept = [t for t, c in zip(typed, named.columns) if c != ROW_ORDER]
    return named.select(*kept, order.alias(ROW_ORDER))


def cleaned_rows(df: DataFrame, profile: Profile, policy: dict[str, Any], duplicate_subset: list[str]) -> DataFrame:
    """What is left of a frame after the dropping policies."""
    rows = coerced_rows(df, profile)
    if policy.get("on_invalid_dates") == "drop":
        rows = rows.dropna(subset=[c for c, t in profile.dtypes.items() if t == "date" and c in rows.columns])
    keys = [c for c in duplicate_subset if c in rows.columns]
    if policy.get("on_duplicates") == "drop":
        rows = keep_first(rows, keys or [c for c in rows.columns if c != ROW_ORDER])
    return rows


def policy_counts(
    df: DataFrame, profile: Profile, policy: dict[str, Any], duplicate_subset: list[str], ranges: dict[str, dict]
) -> DataFrame:
    """Every number the policies look at, as (check_name, column_name, count).

    Coercion counts come from the raw rows, null and duplicate counts from the rows the date policy leaves,
    range counts from the rows the duplicate policy leaves. Counts of stages between which nothing is dropped
    come from one aggregate: with the default policies one pass counts everything but the duplicates.
    """
    named = with_canonical_names(df, profile)
    typed = [c for c in profile.dtypes if c in named.columns]
    dates = [c for c in typed if profile.dtypes[c] == "date"]
    flags = [is_invalid(F.col(c), profile.dtypes[c]).alias(f"_bad_{c}") for c in typed]
    rows = coerced_rows(named.select("*", *flags), profile)

    def long(stage: DataFrame, aggregates: list[tuple[str, str, Column]]) -> DataFrame:
        one = stage.agg(*[a.alias(f"c{i}") for i, (_, _, a) in enumerate(aggregates)])
        found = [
            F.struct(F.lit(k).alias("check_name"), F.lit(c).alias("column_name"), F.col(f"c{i}").cast("long").alias("count"))
            for i, (k, c, _) in enumerate(aggregates)
        ]
        return one.select(F.inline(F.array(*found)))

    counted = [c for c in rows.columns if not c.startswith("_bad_")]
    required = [c for c in profile.required if c in counted]
    stages = [(rows, [
        *[("coercion", c, F.count_if(F.col(f"_bad_{c}"))) for c in typed],
        ("rows_read", "", F.count("*")),
        *[("invalid_date", c, F.count_if(F.col(c).isNull())) for c in dates],
    ])]
    current = rows
    if policy.get("on_invalid_dates") == "drop" and dates:
        current = current.dropna(subset=dates)
        stages.append((current, []))
    stages[-1][1].extend([
        *[("null_required", c, F.count_if(F.col(c).isNull())) for c in required],
        ("rows_after_dates", "", F.count("*")),
    ])
    keys = [c for c in duplicate_subset if c in counted] or [c for c in counted if c != ROW_ORDER]
    groups = current.groupBy(*keys).agg(F.count("*").alias("n"))
    duplicates = long(groups, [("duplicate", "", F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))])
    if policy.get("on_duplicates") == "drop":
        current = keep_first(current.select(*counted), keys)
        stages.append((current, []))
    stages[-1][1].extend([
        *[("range_" + kind, c, F.count_if(t)) for c, kind, t in _range_tests(ranges, counted)],
        ("rows_after_policy", "", F.count("*")),
    ])
    out = duplicates
    for stage, aggregates in stages:
        out = out.unionByName(long(stage, aggregates))
    return out


def validate_profile(
    df: DataFrame, profile: Profile, policy: dict[str, Any], duplicate_subset: list[str], ranges: dict[str, dict]
) -> dict[str, Any]:
    """Report with errors and warnings; PASS_WITH_WARNINGS when only warnings were found."""
    counts: dict[tuple[str, str], int] = {
        (r["check_name"], r["column_name"]): r["count"]
        for r in policy_counts(df, profile, policy, duplicate_subset, ranges).collect()
    }
    errors: list[str] = []
    warnings: list[str] = []
    named = with_canonical_names(df, profile).columns

    missing = sorted(set(profile.required) - set(named))
    if missing:
        errors.append(f"missing required columns: {missing}")
    unknown = sorted(c for c in named if c not in profile.dtypes and c != ROW_ORDER)
    action = policy.get("on_unknown_columns", "warn")
    if unknown and action != "ignore":
        (errors if action == "fail" else warnings).append(f"unknown columns detected: {unknown}")

    coercion = sum(n for (check, _), n in counts.items() if check == "coercion")
    allowed = int(policy.get("type_coercion_fail_threshold", 0))
    if coercion > allowed:
        errors.append(f"type coercion errors={coercion} exceed threshold={allowed}")
    elif coercion:
        warnings.append(f"type coercion errors detected={coercion}")

    rows = counts[("rows_after_dates", "")]
    for (check, column), n in sorted(counts.items()):
        if n == 0:
            continue
        if check == "invalid_date":
            dropped = policy.get("on_invalid_dates") == "drop"
            (warnings if dropped else errors).append(f"invalid date values in '{column}': {n}")
        elif check == "null_required" and rows and n / rows > float(policy.get("null_threshold_required", 0.0)):
            errors.append(f"required column '{column}' null_ratio={n / rows:.4f}")
        elif check == "duplicate":
            (errors if policy.get("on_duplicates") == "fail" else warnings).append(f"duplicate rows: {n}")
        elif check.startswith("range_"):
            errors.append(f"column '{column}' has {n} values outside {check[6:]}")
    status = "FAIL" if errors else "PASS_WITH_WARNINGS" if warnings else "PASS"
    return {"status": status, "errors": errors, "warnings": warnings, "rows": counts[("rows_after_policy", "")]}


def combined_report(reports: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """One report over several files."""
    errors = [f"{name}: {e}" for name, r in reports.items() for e in r["errors"]]
    warnings = [f"{name}: {w}" for name, r in reports.items() for w in r["warnings"]]
    status = "FAIL" if errors else "PASS_WITH_WARNINGS" if warnings else "PASS"
    return {"status": status, "errors": errors, "warnings": warnings, "files": reports}
