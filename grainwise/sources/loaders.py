"""Billing loader: rename, drop, wrap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from grainwise.plans.frame import GrainFrame

# The column contract of the billing export.
BILLING_RENAMES = {"usage_date": "date", "materialized_cost": "cost"}
BILLING_DROPS = (
    "billing_event_id",
    "materialized_discounted_cost",
    "materialized_amortized_cost",
    "materialized_invoiced_cost",
    "materialized_public_cost",
)
BILLING_HIERARCHY = ("cloud_provider", "cloud_account_id", "region", "product_family", "usage_type")


@dataclass(frozen=True)
class LoaderSpec:
    """What a loader renames and drops, and the key order it wraps with."""

    renames: Mapping[str, str] = field(default_factory=lambda: dict(BILLING_RENAMES))
    drops: Sequence[str] = BILLING_DROPS
    hierarchy: Sequence[str] = BILLING_HIERARCHY
    metric_col: str = "cost"
    time_col: str = "date"

    def load(
        self,
        df: DataFrame,
        hierarchy: Sequence[str] | None = None,
        metric_col: str | None = None,
        time_col: str | None = None,
        drop_cols: Sequence[str] | None = None,
    ) -> GrainFrame:
        """Apply the spec; columns that are absent are left out of rename and drop."""
        present = {old: new for old, new in self.renames.items() if old in df.columns}
        shaped = df.withColumnsRenamed(present).drop(*(self.drops if drop_cols is None else drop_cols))
        return GrainFrame.from_dataframe(
            shaped,
            hierarchy=tuple(self.hierarchy if hierarchy is None else hierarchy),
            metric_col=metric_col or self.metric_col,
            time_col=time_col or self.time_col,
        )


class BillingLoader:
    """Loader with the default billing contract."""

    spec = LoaderSpec()

    @classmethod
    def load(cls, df: DataFrame, **overrides) -> GrainFrame:
        return cls.spec.load(df, **overrides)
