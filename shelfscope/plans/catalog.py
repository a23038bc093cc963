"""All registered queries."""

from shelfscope.plans.alert_queries import QUERIES as ALERTS
from shelfscope.plans.feature_queries import QUERIES as FEATURES
from shelfscope.plans.forecast_queries import QUERIES as FORECASTS
from shelfscope.plans.kpi_queries import QUERIES as KPI
from shelfscope.plans.log_queries import QUERIES as LOGS
from shelfscope.plans.model_queries import QUERIES as MODELS
from shelfscope.plans.quality_queries import QUERIES as QUALITY

CATALOG = [*KPI, *QUALITY, *FEATURES, *LOGS, *ALERTS, *FORECASTS, *MODELS]
