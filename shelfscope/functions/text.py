"""Status normalisation, safe error text, message slots, keyword intents and utterance variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, defaults and ordered keyword lists the results depend on.
STORE_PATTERN = r"(?i)(?:store(?:_id)?\s*#?\s*|store_id\s*=?\s*|(?:ل)?(?:ل)?(?:ال)?متجر\s*#?\s*|(?:ال)?متجر\s*#?\s*)(\d+)"
HORIZON_PATTERN = r"(?iU)\b(\d{1,3})\s*(?:day|days|d|يوم|ايام)\b"
DATE_PATTERN = r"(?U)\b(\d{4}-\d{2}-\d{2})\b"
DEFAULT_HORIZON = 30
MAX_HORIZON = 180
DEFAULT_WINDOW_DAYS = 30

GREETING_TERMS = ("hello", "hi", "hey", "مرحبا", "اهلا", "ازيك")
COMPARE_TERMS = ("compare", "vs", "versus", "مقارنة")
SYSTEM_TERMS = (
    "coverage", "how many stores", "rows", "system summary", "data range", "fresh", "latest date",
    "عدد المتاجر", "حجم الداتا", "اخر داتا", "آخر تاريخ",
)
STATUS_TERMS = ("data status", "pipeline", "etl", "data age", "last update")
MODEL_TERMS = (
    "model", "accuracy", "mae", "rmse", "mape", "feature importance", "drift", "retrain", "المودل", "دقة",
)
TOP_STORES_TERM = "اعلى المتاجر"
PROMO_TERMS = ("promo", "برومو", "promot")
FORECAST_TERMS = ("forecast", "predict", "توقع", "فوركاست", "تنبؤ")
KPI_TERMS = ("kpi", "summary", "sales", "customers", "revenue", "ملخص", "مبيعات", "عملاء")

SYNONYMS = {
    "forecast": ("predict", "projection"),
    "predict": ("forecast",),
    "sales": ("revenue",),
    "store": ("branch",),
    "promo": ("promotion",),
    "model": ("algorithm",),
    "summary": ("overview",),
    "data": ("dataset",),
}
STORE_SUFFIXES = (" store 1", " store 25")
DAY_SUFFIXES = (" 30 days", " 90 days")
SAFE_ERROR_CHARS = 512


def upper_or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(value)), F.lit("")), F.lit(default))


def lower_or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(value)), F.lit("")), F.lit(default))


def safe_error_text(value: Column) -> Column:
    """One line, trimmed, at most 512 characters; empty text is null."""
    flat = F.trim(F.regexp_replace(value, r"[\r\n]", " "))
    return F.nullif(F.substring(flat, 1, SAFE_ERROR_CHARS), F.lit(""))


def _has_any(text: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda term: F.contains(text, term))


def store_slot(message: Column) -> Column:
    return F.regexp_extract(message, STORE_PATTERN, 1).try_cast("bigint")


def horizon_slot(message: Column) -> Column:
    days = F.regexp_extract(message, HORIZON_PATTERN, 1).try_cast("int")
    return F.coalesce(
        F.least(F.greatest(days, F.lit(1)), F.lit(MAX_HORIZON)), F.lit(DEFAULT_HORIZON)
    )


def date_range_slots(message: Column, latest: Column) -> tuple[Column, Column]:
    """Two dates give an ordered range, one ends a 30-day window, none means the last 30 data days."""
    found = F.regexp_extract_all(message, F.lit(DATE_PATTERN), 1)
    first = F.try_to_date(F.get(found, F.lit(0)), "yyyy-MM-dd")
    second = F.try_to_date(F.get(found, F.lit(1)), "yyyy-MM-dd")
    end = F.when(F.size(found) >= 2, F.greatest(first, second)).when(F.size(found) == 1, first).otherwise(latest)
    start = F.when(F.size(found) >= 2, F.least(first, second)).otherwise(
        F.date_sub(end, DEFAULT_WINDOW_DAYS - 1)
    )
    return start, end


def keyword_intent(message: Column) -> Column:
    """First matching keyword group wins; the order of the groups is part of the result."""

    def chain(text: Column) -> Column:
        store = F.contains(text, F.lit("store"))
        top = F.contains(text, F.lit("top")) & store
        return (
            F.when(_has_any(text, GREETING_TERMS), "greeting")
            .when(_has_any(text, COMPARE_TERMS) & store, "compare_stores")
            .when(_has_any(text, SYSTEM_TERMS), "system_summary")
            .when(_has_any(text, STATUS_TERMS), "data_status")
            .when(_has_any(text, MODEL_TERMS), "model_summary")
            .when(top | F.contains(text, F.lit(TOP_STORES_TERM)), "top_stores")
            .when(_has_any(text, PROMO_TERMS), "promo_impact")
            .when(_has_any(text, FORECAST_TERMS), "forecast")
            .when(_has_any(text, KPI_TERMS), "kpi_summary")
            .otherwise("help")
        )

    # Inside the lambda the lowered text is a variable: it is computed once, not once per keyword.
    return F.get(F.transform(F.array(F.lower(message)), chain), F.lit(0))


def utterance_variants(sample: Column) -> Column:
    """Distinct rewrites of one utterance: spacing, case, synonyms and slot suffixes."""
    normal = F.regexp_replace(F.trim(sample), r"\s+", " ")
    lowered = F.lower(normal)
    variants = [sample, normal, lowered]
    for word, swaps in SYNONYMS.items():
        for swap in swaps:
            variants.append(F.when(F.contains(lowered, F.lit(word)), F.replace(lowered, F.lit(word), F.lit(swap))))
    needs_store = F.contains(lowered, F.lit("store ")) & ~F.rlike(lowered, F.lit(r"store\s+\d+"))
    variants += [F.when(needs_store, F.concat(lowered, F.lit(tail))) for tail in STORE_SUFFIXES]
    needs_days = F.contains(lowered, F.lit("day")) & ~F.rlike(lowered, F.lit(r"\d+\s*(day|days|d)"))
    variants += [F.when(needs_days, F.concat(lowered, F.lit(tail))) for tail in DAY_SUFFIXES]
    return F.array_distinct(F.filter(F.array(*variants), lambda v: v.isNotNull() & (v != "")))
