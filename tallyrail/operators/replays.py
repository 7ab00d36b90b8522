"""Frozen records of open schemas: read back as VARIANT, with the known fields shredded into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a frozen probe, their types and what holds where a record lacks them.
PROBE = {"probe_id": ("string", ""), "stability_group": ("string", ""), "repetition": ("int", 0), "purpose": ("string", ""), "expected_safe": ("boolean", True)}


def shredded(record: Column, fields: dict[str, tuple[str, object]]) -> list[Column]:
    """Typed columns of a VARIANT's fields, with a default where one is missing, null or of another type."""
    return [F.coalesce(F.try_variant_get(record, f"$.{name}", kind), F.lit(default).cast(kind)).alias(name) for name, (kind, default) in fields.items()]


def rehydrated(records: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Probes of frozen JSON records: the columns ``keep``, those of PROBE, and ``input_case`` as VARIANT, whatever it holds.

    Inputs are read back and never made anew from a seed. A line that is no JSON is an error.
    """
    parsed = records.select(*keep, F.parse_json(text).alias("_r"))
    return parsed.select(*keep, *shredded(F.col("_r"), PROBE), F.try_variant_get("_r", "$.input_case", "variant").alias("input_case"))


def batch_counts(probes: DataFrame, observations: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Per group: probes, executed (those with an observation), and ``valid``, whose status is ``returned``."""
    seen = observations.select(*key, "status")
    return probes.join(seen, key, "left").groupBy(*by).agg(F.count("*").alias("probes"), F.count("status").alias("executed"), F.count_if(F.col("status") == "returned").alias("valid"))
