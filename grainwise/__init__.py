"""Grain-level cost and time-series analytics as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

from grainwise.plans.frame import GrainError, GrainFrame
from grainwise.session import get_spark_session
from grainwise.sources.loaders import BillingLoader, LoaderSpec

__all__ = ["BillingLoader", "GrainError", "GrainFrame", "LoaderSpec", "get_spark_session"]

# Helpers of the few Python stages travel inside the task, so that executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
