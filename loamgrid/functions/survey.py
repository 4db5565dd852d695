"""Decoding of survey estimates and eligibility of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Special values of published survey tables: value and meaning, fixed values.
SENTINELS = ((-999999999.0, "sentinel_no_data_small_sample"), (-888888888.0, "sentinel_not_applicable_or_available"), (-666666666.0, "sentinel_insufficient_sample"), (-555555555.0, "sentinel_controlled_moe"), (-333333333.0, "sentinel_open_ended_median_moe"), (-222222222.0, "sentinel_moe_not_computable"))


def survey_status(text: Column) -> Column:
    """observed, json_null, blank, nonnumeric, a sentinel's meaning or other_negative."""
    value = F.trim(text).try_cast("double")
    out = F.when(text.isNull(), "json_null").when(F.trim(text) == "", "blank").when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "nonnumeric")
    for v, name in SENTINELS:
        out = out.when(value == v, name)
    return out.when(value < 0, "other_negative").otherwise("observed")


def survey_estimate(text: Column) -> Column:
    """The number of an observed value, else null."""
    return F.when(survey_status(text) == "observed", F.trim(text).try_cast("double"))


def survey_margin(text: Column) -> Column:
    """The margin of error: observed, or 0 where the estimate is controlled."""
    status = survey_status(text)
    return F.when(status == "sentinel_controlled_moe", 0.0).when(status == "observed", F.trim(text).try_cast("double"))


def exclusion_reason(columns: list[str], response: str | None = None) -> Column:
    """Why a record is left out: each column that is null or not finite, and a response that isn't positive; empty if kept."""
    def bad(c: str) -> Column:
        v = F.col(c).cast("double")
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    parts = [F.when(bad(c), F.lit(f"missing_estimate:{c}")) for c in columns]
    if response is not None:
        parts.append(F.when(~bad(response) & (F.col(response) <= 0), F.lit("nonpositive_response")))
    return F.array_join(F.filter(F.array(*parts), lambda v: v.isNotNull()), ";")
