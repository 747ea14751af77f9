"""Telemetry families: which logs, files and edges belong to which."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AUDIT_FILES, FAMILIES, FAMILY_ALIASES


def normalize(family: str | None) -> str:
    """full, audit, zeek or eve; aliases allowed, others are an error."""
    f = (family or "full").strip().lower()
    f = FAMILY_ALIASES.get(f, f)
    if f not in FAMILIES:
        raise ValueError(f"unknown telemetry family {family!r}")
    return f


def log_in_family(log: str, family: str) -> bool:
    name, family = (log or "").strip().lower(), normalize(family)
    if family == "full":
        return True
    if family == "eve":
        return name in ("eve", "suricata") or name.startswith(("eve_", "suricata_"))
    return name.startswith({"audit": "azure_", "zeek": "zeek_"}[family])


def family_of(source_file: Column) -> Column:
    """audit, zeek or eve by a file's base name in any folder; null if unknown."""
    name = F.lower(F.element_at(F.split(F.trim(source_file), "/"), -1))
    return F.when(name == "eve.json", "eve").when(name.isin(list(AUDIT_FILES)), "audit").when(name.startswith("zeek_"), "zeek")


def only_family(rows: DataFrame, family: str) -> DataFrame:
    family = normalize(family)
    return rows if family == "full" else rows.where(family_of(F.col("source_file")) == family)


def supports(catalog: dict, scenario: str, family: str) -> bool:
    """Whether any configured log of the scenario belongs to the family."""
    return any(log_in_family(log, family) for log in catalog.get(scenario, {}))


def logs_to_read(catalog: dict, scenario: str, family: str = "full", only_ioc_logs: bool = True) -> dict:
    """The scenario's logs after pruning by family and by indicators."""
    return {name: spec for name, spec in catalog.get(scenario, {}).items() if log_in_family(name, family) and (spec.get("has_ioc") or not only_ioc_logs)}


def ioc_files(catalog: dict, scenarios: Iterable[str] | None = None) -> list[str]:
    return sorted({spec["filename"] for sc in scenarios or catalog for spec in catalog[sc].values() if spec.get("has_ioc")})
