"""The canonical offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFER = """
source string, source_id string, url string, title string, company string, description string, raw_html string,
location string, remote string, contract string, daily_rate_min int, daily_rate_max int, freelance_marker string,
duration_months double, skills array<string>, published_at timestamp
"""
DEFAULTS = {"source_id": "", "url": "", "title": "", "company": "", "description": "", "raw_html": "", "location": "", "remote": "unknown", "contract": "unknown"}
FIELDS = [x.strip().split(" ", 1) for x in OFFER.replace("\n", " ").split(", ")]


def canonical(rows: DataFrame, *extra: str) -> DataFrame:
    """All fields of an offer in order, missing or null ones with their default; extra columns follow."""
    columns: list[Column] = []
    for name, kind in FIELDS:
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        if name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[name]))
        if name == "skills":
            value = F.coalesce(value, F.array().cast("array<string>"))
        columns.append(value.alias(name))
    return rows.select(*columns, *extra)


def settled(rows: DataFrame) -> DataFrame:
    """The same rows. A filter above is not pushed below this point, where the optimizer would put a copy of every long
    expression that the filter's columns stand for into it."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))
