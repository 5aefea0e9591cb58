"""What a column is, judged by its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules; the first pattern that occurs in the lower-cased name wins.
# (pattern, category, subcategory, expected, unit, quality checks)
NON_NEGATIVE = "non-negative numeric (or small negative for refunds), right-skewed"
COST_CHECKS = "check for negative values, check for extreme outliers"
RULES = (
    ("(cost|price|charge).*discount|discount.*(cost|price|charge)", "financial", "cost_discounted",
     NON_NEGATIVE, "currency", COST_CHECKS),
    ("(cost|price|charge).*amortiz|amortiz.*(cost|price|charge)", "financial", "cost_amortized",
     NON_NEGATIVE, "currency", COST_CHECKS),
    ("(cost|price|charge).*invoice|invoice.*(cost|price|charge)", "financial", "cost_invoiced",
     NON_NEGATIVE, "currency", COST_CHECKS),
    ("(cost|price|charge).*(public|demand)|(public|demand).*(cost|price|charge)", "financial", "cost_list_price",
     NON_NEGATIVE, "currency", COST_CHECKS),
    ("cost|price|charge", "financial", "cost_unknown", NON_NEGATIVE, "currency", COST_CHECKS),
    ("usage|consumption", "consumption", "usage_metric", "non-negative numeric, possibly zero",
     "varies (GB, hours, requests)", "check for negative values, check zero prevalence"),
    ("uuid", "identifier", "unique_key", "high cardinality string, minimal nulls", "none",
     "check uniqueness, check null rate"),
    ("id|arn|key", "identifier", "reference_key", "high cardinality string, minimal nulls", "none",
     "check uniqueness, check null rate"),
    ("date", "temporal", "date", "datetime type, sequential, no gaps", "datetime",
     "check for gaps, check range validity"),
    ("time|period", "temporal", "timestamp", "datetime type, sequential, no gaps", "datetime",
     "check for gaps, check range validity"),
    ("^_k8s|kubernetes", "kubernetes", "container_metadata", "sparse (high nulls), categorical", "none",
     "expect high null percentage, check cardinality"),
    ("account", "cloud_hierarchy", "account_identifier", "medium cardinality, categorical", "none",
     "check cardinality matches expected accounts"),
    ("product|service|family", "cloud_hierarchy", "product_taxonomy", "low-medium cardinality, categorical", "none",
     "check value set consistency"),
    ("provider|cloud", "cloud_hierarchy", "provider", "low cardinality (AWS/Azure/GCP), categorical", "none",
     "check for expected provider names"),
    ("region|zone|location", "cloud_hierarchy", "geographic", "low-medium cardinality, categorical", "none",
     "check for valid region codes"),
    ("name|description|label|tag", "metadata", "descriptive", "high cardinality string, possibly sparse", "none",
     "check informativeness"),
    ("aggregat|count", "aggregation", "record_count", "positive integer", "count",
     "check for zeros, check distribution"),
)
UNKNOWN = ("unknown", "unclassified", "requires investigation", "unknown", "manual inspection needed")
FIELDS = ("category", "subcategory", "expected", "unit", "quality_checks")


def column_semantics(name: str | Column) -> Column:
    """Struct of category, subcategory, expectation, unit and quality checks for a name."""
    lowered = F.lower(F.col(name) if isinstance(name, str) else name)

    def as_struct(values) -> Column:
        return F.struct(*(F.lit(v).alias(f) for f, v in zip(FIELDS, values, strict=True)))

    chosen: Column | None = None
    for pattern, *values in RULES:
        test, result = lowered.rlike(pattern), as_struct(values)
        chosen = F.when(test, result) if chosen is None else chosen.when(test, result)
    return chosen.otherwise(as_struct(UNKNOWN))


def cardinality_class(ratio: str | Column) -> Column:
    """High above 1 %, Medium above 0.01 %, else Low."""
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    return F.when(ratio > 0.01, "High").when(ratio > 0.0001, "Medium").otherwise("Low")
