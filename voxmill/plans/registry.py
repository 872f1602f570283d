"""All queries by name, and the SQL that other engines answer them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from voxmill.plans.domain import Domain, oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def add(name: str, plan: Callable[[Domain], DataFrame], sql: str | None = None) -> None:
    """Registers ``plan`` as q_<name>; ``sql`` may name the derived views."""
    if f"q_{name}" in QUERIES:
        raise ValueError(f"{name} is registered already")
    QUERIES[f"q_{name}"] = lambda spark, sf_dir: plan(Domain(spark, sf_dir))
    if sql:
        ORACLES[f"q_{name}"] = oracle(sql)


from voxmill.plans import aggregates, filters, jobs, joins, replay, scalars, snapshots, sources, streams, windows  # noqa: E402, F401
