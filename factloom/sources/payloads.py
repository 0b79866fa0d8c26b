"""Archived facts as typed fact tables: the latest readable delivery of each fact, its payload cast to declared fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import nested
from ..operators.facts import FactTable, first_per
from ..session import written

#: Declared fields: a type name is a scalar, [..] a list, dict an object, ("map", type) a map.
FIELDS: dict[str, dict] = {
    "DataAssetFact": {"assets": [{"identifier": "string", "domain": "string", "owners": ["string"], "lifecycle": "string", "is_changed": "boolean", "fields": [{"name": "string", "data_type": "string", "description": "string", "tags": ["string"], "glossary_terms": ["string"]}]}]},
    "DataAssetReferenceFact": {"references": [{"source_location": "string", "asset_identifier": "string", "asset_exists": "boolean", "upstream_health": ("map", "string")}]},
    "CloneGroupFact": {"token_length": "bigint", "fragments": [{"path": "string", "start_line": "bigint", "lines": ["string"]}]},
    "WaiverFact": {"waivers": [{"location": "string", "age_days": "bigint", "is_overly_broad": "boolean", "metadata": ("map", "variant")}]},
    "TestSuiteFact": {"strict_controls": ("map", "boolean"), "markers": ["string"], "import_mode": "string"},
    "ChangeFact": {"changes": [{"identifier": "string", "author": "string", "emergency": "boolean", "review": {"required": "boolean", "approvals": [{"reviewer": "string", "approved": "boolean", "eligible": "boolean"}]}, "verification_evidence": ["string"]}]},
}


def _typed(v: str, kind, n: int) -> str:
    if isinstance(kind, str):
        return v if kind == "variant" else f"try_variant_get({v}, '$', '{kind}')"
    if isinstance(kind, tuple):
        return f"transform({nested._pairs(v)}, m{n} -> named_struct('key', m{n}.key, 'value', {_typed(f'm{n}.value', kind[1], n + 1)}))"
    if isinstance(kind, list):
        return f"transform({nested._items(v)}, x{n} -> {_typed(f'x{n}', kind[0], n + 1)})"
    fields = ", ".join(f"'{name}', {_typed(nested._field(f'o{n}', name), inner, n + 1)}" for name, inner in kind.items())
    return f"transform(array({nested._object(v)}), o{n} -> named_struct({fields}))[0]"


def facts(raw: DataFrame, family: str) -> DataFrame:
    """One row per fact of a family: identity, repository and the typed fields. Unreadable deliveries are passed over."""
    own = raw.where((F.col("family") == family) & F.col("payload").isNotNull())
    keys = own.select("delivery_id", "fact_id", "repository", "path", "language", "observed_at", "ingested_at")
    read = nested.payloads(own.select("fact_id", "family", "payload", "delivery_id"), ("delivery_id",)).where(nested._is_object("v"))
    latest = first_per(read.join(keys.drop("fact_id"), "delivery_id"), ["fact_id"], F.col("observed_at").desc_nulls_last(), F.col("ingested_at").desc_nulls_last(), F.col("delivery_id").desc())
    identity = [F.col("delivery_id").alias("fact_order"), "fact_id", "path", F.lit(1).cast("long").alias("start_line"), F.lit(0).cast("long").alias("start_column"), F.lit(1).cast("long").alias("end_line"), F.lit(0).cast("long").alias("end_column"), "language"]
    return latest.select(*identity, "repository", F.expr(_typed("v", FIELDS[family], 0)).alias("p")).select("*", "p.*").drop("p")


def table(raw: DataFrame, family: str) -> FactTable:
    """The family as a fact table; each list of records is a relation with fact_id and ordinal."""
    rows = written(facts(raw, family))
    relations = {"facts": rows}
    for name, kind in FIELDS[family].items():
        if isinstance(kind, list) and isinstance(kind[0], dict):
            relations[name] = rows.select("fact_id", F.posexplode(name).alias("ordinal", "r")).select("fact_id", "ordinal", "r.*")
    return FactTable(family, relations)
