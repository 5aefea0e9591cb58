"""Column expressions over resource utilisation and cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cost_per_cpu(cost: str = "hourly_cost", cores: str = "cpu_cores") -> Column:
    return F.col(cost) / (F.col(cores) + 0.001)


def cost_per_gb(cost: str = "hourly_cost", memory_gb: str = "memory_gb") -> Column:
    return F.col(cost) / (F.col(memory_gb) + 0.001)


def mean_utilisation(cpu: str = "cpu_utilization", memory: str = "memory_utilization") -> Column:
    """Plain efficiency: the mean of both utilisations."""
    return (F.col(cpu) + F.col(memory)) / 2


def _unused(used: str, floor: float) -> Column:
    wanted = F.greatest(F.col(used) * 1.2, F.lit(floor))
    return F.greatest(F.lit(0.0), (100 - wanted) / 100)


def waste_with_headroom(cpu: str = "cpu_utilization", memory: str = "memory_utilization") -> Column:
    """Percent of capacity left after 20 % headroom, with floors of 30 (cpu) and 40 (memory)."""
    return (_unused(cpu, 30.0) + _unused(memory, 40.0)) / 2 * 100


def waste_linear(cpu: str = "cpu_utilization", memory: str = "memory_utilization") -> Column:
    return 0.5 * (100 - F.col(cpu)) + 0.5 * (100 - F.col(memory))


def is_idle(cpu: str = "cpu_utilization", memory: str = "memory_utilization") -> Column:
    return (F.col(cpu) < 5) & (F.col(memory) < 10)


def is_overprovisioned(cpu: str | Column = "cpu_utilization", memory: str | Column = "memory_utilization") -> Column:
    cpu = F.col(cpu) if isinstance(cpu, str) else cpu
    memory = F.col(memory) if isinstance(memory, str) else memory
    return (cpu < 20) & (memory < 30)


def efficiency_score(
    waste_factor: Column, cpu: str = "cpu_utilization", memory: str = "memory_utilization"
) -> Column:
    """Closeness to 70 % cpu and 80 % memory, less the workload's waste factor, within 0..100."""
    near_cpu = 100 - F.abs(F.col(cpu) - 70)
    near_memory = 100 - F.abs(F.col(memory) - 80)
    score = (near_cpu + near_memory) / 2 - waste_factor * 100
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))


def lookup(key: str, table: Mapping[str, float], default: float | None = None) -> Column:
    """Constant lookup table as a map literal; unknown keys give the default."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), F.col(key))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def category_index(key: str, categories: Sequence[str]) -> Column:
    """Position in the list; unknown values map to 0."""
    return lookup(key, {c: i for i, c in enumerate(categories)}, 0).cast("int")


def fourier_terms(value: Column, period: float, terms: int, prefix: str) -> dict[str, Column]:
    """cos and sin features of order 1..terms for a cyclic value."""
    out: dict[str, Column] = {}
    for k in range(1, terms + 1):
        angle = value * F.lit(2.0 * k / period) * F.pi()
        out[f"{prefix}_cos{k}"] = F.cos(angle)
        out[f"{prefix}_sin{k}"] = F.sin(angle)
    return out
