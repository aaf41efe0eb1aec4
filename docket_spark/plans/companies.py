"""Curated company identities and their resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket_spark.constants import COMPANY_REGISTRY
from docket_spark.functions.text import SPACE_SEPARATORS, alphanumeric_fold, company_key


def _key(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def registry_entries(registry=COMPANY_REGISTRY) -> dict[str, tuple[str, str | None, bool]]:
    """Company key to (legal name, brand, is alias); an alias replaces an equal legal name."""
    entries: dict[str, tuple[str, str | None, bool]] = {}
    for legal, brand, aliases in registry:
        entries[_key(legal)] = (legal, brand, False)
        entries.update({_key(alias): (legal, brand, True) for alias in aliases})
    return entries


def brand_of(key: Column, registry=COMPANY_REGISTRY) -> Column:
    """Brand of a company key, NULL when the key is not curated.

    A constant map, so that the key, itself a pattern replacement, is evaluated once per row.
    """
    pairs = [
        F.lit(part)
        for entry, (_, brand, _) in registry_entries(registry).items()
        for part in (entry, brand)
    ]
    return F.try_element_at(F.create_map(*pairs), key)


def identity_table(spark: SparkSession, registry=COMPANY_REGISTRY) -> DataFrame:
    rows = [(key, *entry) for key, entry in registry_entries(registry).items()]
    return spark.createDataFrame(
        rows, "company_key string, legal_company string, brand_name string, is_alias boolean"
    )


def resolve_companies(
    requests: DataFrame, value: str, registry=COMPANY_REGISTRY
) -> DataFrame:
    """Resolve a company or brand text against the registry without guessing.

    The registry is a handful of literal rows, so Spark's size estimate makes this a broadcast
    join by itself.
    """
    cleaned = F.btrim(F.col(value), F.lit(SPACE_SEPARATORS + "\t\n\r"))
    keyed = requests.withColumns(
        {"input_value": F.coalesce(F.nullif(cleaned, F.lit("")), F.col(value))}
    ).withColumn("company_key", company_key(F.col("input_value")))
    status = (
        F.when(F.col("is_alias"), "curated_alias")
        .when(~F.col("is_alias"), "normalized_legal_name")
        .otherwise("unresolved")
    )
    return (
        keyed.join(identity_table(requests.sparkSession, registry), "company_key", "left")
        .withColumn("status", status)
        .drop("company_key", "is_alias")
    )


def entity_conflicts(
    explicit_company: Column, explicit_brand: Column, legal_company: Column, brand: Column
) -> Column:
    """Why an explicit company or brand contradicts a resolved identity, NULL when it does not."""
    other_company = alphanumeric_fold(explicit_company) != alphanumeric_fold(legal_company)
    return (
        F.when((F.length(explicit_company) > 0) & other_company, "company conflict")
        .when(
            (F.length(explicit_brand) > 0) & ~explicit_brand.eqNullSafe(brand), "brand conflict"
        )
    )
