"""Preflight of one raw file and the load of the warehouse behind it."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from shelfscope.operators import quality, validation, warehouse
from shelfscope.operators.validation import FAIL, SKIPPED, WARN
from shelfscope.sources import files, sinks
from shelfscope.sources.contracts import InputContract

MODES = ("off", "report_only", "enforce")
RUN_SCHEMA = (
    "run_id string, source_name string, created_at timestamp, mode string, validation_status string, "
    "semantic_status string, final_status string, used_input_path string, used_unified boolean, artifact_dir string, "
    "blocked boolean, block_reason string, data_source_id int, contract_id string, contract_version string"
)


@dataclass(frozen=True)
class PreflightResult:
    run_id: str
    source_name: str
    mode: str
    validation_status: str
    semantic_status: str
    final_status: str
    used_input_path: str
    used_unified: bool
    artifact_dir: str | None
    blocked: bool
    block_reason: str | None
    data_source_id: int | None = None
    contract_id: str | None = None
    contract_version: str | None = None

    def record(self, spark: SparkSession) -> DataFrame:
        """The run-log row."""
        values = {**asdict(self), "created_at": datetime.now(timezone.utc)}
        names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(values[n] for n in names)], RUN_SCHEMA)


def final_status(validation_status: str, semantic_status: str) -> str:
    statuses = {validation_status, semantic_status}
    if FAIL in statuses:
        return FAIL
    if WARN in statuses:
        return WARN
    return SKIPPED if statuses == {SKIPPED} else "PASS"


def validate_file(spark: SparkSession, path: str, contract: InputContract, profile: str) -> tuple[dict[str, Any], DataFrame | None]:
    """File checks first; the content is read only when these hold."""
    facts = files.file_facts(spark, path)
    report = validation.blank_report(contract, profile)
    report["metadata"] |= {"file_name": facts.name, "file_size_bytes": facts.size_bytes, "encoding": None}
    problems = []
    if not facts.exists:
        problems.append(("format", f"File does not exist: {path}"))
    else:
        if contract.max_file_size_mb is not None and facts.size_bytes > contract.max_file_size_mb * 1024 * 1024:
            problems.append(("file_size", f"File size {facts.size_bytes} exceeds {contract.max_file_size_mb} MB"))
        if not facts.is_csv:
            problems.append(("format", "Unsupported extension. Expected .csv"))
    if problems:
        for check, message in problems:
            report["checks"][check] = FAIL
            report["errors"].append(message)
        report["status"] = FAIL
        return report, None
    encoding = files.choose_encoding(spark, path)
    raw = files.read_raw_csv(spark, path, encoding, contract.multiline)
    content = validation.validate_frame(raw, contract, profile)
    content["metadata"] |= {"file_name": facts.name, "file_size_bytes": facts.size_bytes, "encoding": encoding}
    return content, raw


def run_preflight(
    spark: SparkSession,
    path: str,
    contract: InputContract,
    profile: str,
    mode: str,
    artifact_root: str,
    source_name: str,
    run_id: str,
    log_path: str | None = None,
    data_source_id: int | None = None,
    contract_id: str | None = None,
) -> PreflightResult:
    """Validation, unification and rules of one input.

    off: nothing is read or written. report_only: reports are written, the load still uses the raw file.
    enforce: a failure blocks the load, otherwise the unified file is used.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "off":
        return PreflightResult(
            run_id, source_name, mode, SKIPPED, SKIPPED, SKIPPED, path, False, None, False, None, data_source_id,
            contract_id, contract.version,
        )
    folder = f"{artifact_root}/{run_id}/{source_name}"
    report, raw = validate_file(spark, path, contract, profile)
    sinks.write_json_report(spark, report, f"{folder}/validation_report")
    semantic, manifest = SKIPPED, None
    if report["status"] != FAIL:
        unified, manifest = validation.unify_frame(raw, contract, profile, report, report["metadata"]["file_name"])
        # The raw text is parsed once more for this; rules, export and load then read typed columns.
        unified.write.mode("overwrite").parquet(f"{folder}/unified.parquet")
        unified = spark.read.parquet(f"{folder}/unified.parquet")
        results = [r.asDict() for r in quality.evaluate_rules(unified, list(contract.profile(profile).rules)).collect()]
        semantic = validation.worst(r["status"] for r in results)
        counts = {"total": len(results)} | {
            name: sum(r["status"] == status for r in results)
            for name, status in (("passed", "PASS"), ("warned", WARN), ("failed", FAIL))
        }
        body = {"status": semantic, "counts": counts, "rules": results}
        sinks.write_json_report(spark, body, f"{folder}/semantic_report")
        manifest["semantic_quality"] = body
        sinks.write_json_report(spark, manifest, f"{folder}/unification_manifest")
        sinks.write_unified_csv(unified, f"{folder}/unified.csv")

    status = final_status(report["status"], semantic)
    blocked = mode == "enforce" and status == FAIL
    reason = None
    if blocked:
        reason = "validation failed" if report["status"] == FAIL else "semantic quality failed"
    used_unified = mode == "enforce" and not blocked and manifest is not None
    result = PreflightResult(
        run_id, source_name, mode, report["status"], semantic, status,
        f"{folder}/unified.parquet" if used_unified else path, used_unified, folder, blocked, reason, data_source_id,
        contract_id, contract.version,
    )
    sinks.write_json_report(spark, asdict(result), f"{folder}/preflight_report")
    if log_path:
        sinks.append_log(result.record(spark), log_path)
    return result


def run_load(
    spark: SparkSession,
    sales_csv: str,
    store_csv: str,
    contract: InputContract,
    mode: str,
    root: str,
    run_id: str,
) -> dict[str, Any]:
    """Preflight of both inputs, then cleaning, dimensions and fact, then a full reload of the warehouse."""
    started = datetime.now(timezone.utc)
    log = f"{root}/logs/etl_runs"
    schema = "run_id string, status string, created_at timestamp, updated_at timestamp, message string"

    def record(status: str, message: str | None = None) -> None:
        row = (run_id, status, started, datetime.now(timezone.utc), message)
        sinks.append_log(spark.createDataFrame([row], schema), log)

    record("RUNNING")
    try:
        checks = {
            name: run_preflight(spark, path, contract, name, mode, f"{root}/artifacts", name, run_id, f"{root}/logs/preflight_runs")
            for name, path in (("train", sales_csv), ("store", store_csv))
        }
        stopped = [c for c in checks.values() if c.blocked]
        if stopped:
            raise RuntimeError("; ".join(f"{c.source_name}: {c.block_reason}" for c in stopped))
        used = [checks[name].used_input_path for name in ("train", "store")]
        raw_sales, raw_store = files.load_raw_data(spark, *used, multiline=contract.multiline)
        sales, stores = warehouse.clean_sales(raw_sales), warehouse.clean_store(raw_store)
        fact = warehouse.build_fact(sales)
        sinks.reload_warehouse(fact, stores, warehouse.build_dim_date(sales), f"{root}/warehouse")
        record("COMPLETED")
        return {"status": "COMPLETED", "checks": checks, "warehouse": f"{root}/warehouse"}
    except Exception as error:
        record("FAILED", str(error)[:512])
        raise
