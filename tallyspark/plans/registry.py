"""The pipelines by section, and a run over all of them: incomplete sections are skipped, failures reported."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.sheets import save
from . import daily, marketing, monitoring, o2c, report

#: Words by which an uploaded file is recognised.
FILE_ROLES = {
    "so": {"prefixes": ("so summary", "so -"), "words": ("sales order", "so"), "exclude": ("packing", "invoice")},
    "packing": {"prefixes": ("packing",), "words": ("packing",)},
    "invoice": {"prefixes": ("invoice",), "words": ("invoice",)},
    "target": {"prefixes": ("target",), "words": ("target",)},
    "brand": {"prefixes": ("list brand",), "words": ("brand",)},
    "visitplan": {"prefixes": ("visit plan",), "words": ("visit", "plan")},
}


@dataclass(frozen=True)
class Section:
    needs: tuple[str, ...]
    tables: dict[str, Callable]


SECTIONS = {
    "daily": Section(("lineitem", "orders", "customer", "part", "supplier"), daily.QUERIES),
    "monitoring": Section(("lineitem", "orders", "customer"), monitoring.QUERIES),
    "o2c": Section(("lineitem", "orders", "customer"), o2c.QUERIES),
    "marketing": Section(("events",), marketing.QUERIES),
    "tracker": Section(("events",), {k: f for k, f in report.QUERIES.items() if k.startswith("q_visit")}),
}


def run_all(spark: SparkSession, sf_dir: str, have: set[str], out: str | None = None) -> dict[str, dict]:
    """section to {status, tables}; tables stay lazy unless ``out`` names a folder to load them to."""
    result: dict[str, dict] = {}
    for name, section in SECTIONS.items():
        missing = [n for n in section.needs if n not in have]
        if missing:
            result[name] = {"status": "SKIPPED", "missing": missing, "tables": {}}
            continue
        try:
            tables: dict[str, DataFrame] = {k: f(spark, sf_dir) for k, f in section.tables.items()}
            if out is not None:
                for k, df in tables.items():
                    save(df, f"{out}/{name}/{k}")
            result[name] = {"status": "COMPLETED", "tables": tables}
        except Exception as error:  # one section must not stop the others
            result[name] = {"status": "FAILED", "error": str(error), "tables": {}}
    return result
