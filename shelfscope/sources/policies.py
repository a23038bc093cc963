"""Alert policies and delivery channels: configuration read on the driver."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from shelfscope.functions.numeric import OPERATORS

# Fixed values.
METRICS = (
    "fail_rate", "blocked_count", "top_rule_fail_count", "semantic_rule_fail_count", "unified_usage_rate", "fail_count",
)
SEVERITIES = ("LOW", "MEDIUM", "HIGH")
SOURCES = ("train", "store")
POLICY_SCHEMA = (
    "policy_id string, severity string, policy_source string, window_days int, metric_type string, operator string, "
    "threshold double, pending_evaluations int, policy_rule string, description string"
)
MOST_DAYS = 3650


@dataclass(frozen=True)
class Policy:
    policy_id: str
    severity: str
    policy_source: str | None
    window_days: int
    metric_type: str
    operator: str
    threshold: float
    pending_evaluations: int = 1
    policy_rule: str | None = None
    description: str = ""
    enabled: bool = True

    def __post_init__(self):
        for ok, what in (
            (bool(self.policy_id), "id"),
            (self.severity in SEVERITIES, "severity"),
            (self.policy_source is None or self.policy_source in SOURCES, "source_name"),
            (1 <= self.window_days <= MOST_DAYS, "window_days"),
            (self.metric_type in METRICS, "metric_type"),
            (self.operator in OPERATORS, "operator"),
            (self.pending_evaluations >= 1, "pending_evaluations"),
            (self.metric_type != "semantic_rule_fail_count" or bool(self.policy_rule), "rule_id"),
        ):
            if not ok:
                raise ValueError(f"alert policy {self.policy_id!r}: bad {what}")


def _threshold(payload: dict) -> float:
    try:
        return float(payload.get("threshold"))
    except (TypeError, ValueError):
        raise ValueError(f"alert policy {payload.get('id')!r}: threshold must be a number") from None


def parse_policy(payload: dict) -> Policy:
    source = payload.get("source_name")
    return Policy(
        str(payload.get("id") or "").strip(),
        str(payload.get("severity") or "MEDIUM").strip().upper(),
        str(source).strip().lower() if source else None,
        int(payload.get("window_days", 7)),
        str(payload.get("metric_type") or "").strip().lower(),
        str(payload.get("operator") or "").strip(),
        _threshold(payload),
        int(payload.get("pending_evaluations", 1)),
        payload.get("rule_id"),
        str(payload.get("description") or "").strip() or str(payload.get("id") or "").strip(),
        bool(payload.get("enabled", True)),
    )


def load_policies(path: str | Path) -> list[Policy]:
    payload = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    policies = [parse_policy(p) for p in payload.get("policies", [])]
    ids = [p.policy_id for p in policies]
    if len(set(ids)) != len(ids):
        raise ValueError("duplicate alert policy ids")
    return policies


def policy_frame(spark: SparkSession, policies: list[Policy]) -> DataFrame:
    """Enabled policies as a frame; its size is that of the configuration file."""
    names = [c.split()[0] for c in POLICY_SCHEMA.split(", ")]
    rows = [tuple(asdict(p)[n] for n in names) for p in policies if p.enabled]
    return spark.createDataFrame(rows, POLICY_SCHEMA)


def load_channels(path: str | Path) -> list[dict]:
    payload = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return list(payload.get("channels", []))
