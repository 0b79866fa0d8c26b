import json

import brute
import pytest
from conftest import DATA, needs_data
from factloom.operators import nested
from factloom.sources import payloads
from pyspark.sql import functions as F

COLUMNS = ["fact_id", "entry_kind", "parent_id", "container_id", "container_ordinal", "map_key", "entry_id"]
CASES = [
    ("DataAssetFact", {"assets": [{"identifier": "a", "owners": ["x", None], "fields": {"name": "f", "tags": '["t"]', "glossary_terms": []}}, None]}),
    ("DataAssetFact", {"fact": {"assets": []}, "schema_version": 1}),
    ("CollectionFact", {"pairSequences": [["a", 1], [], None, [None]], "localCollections": None}),
    ("WaiverFact", {"waivers": [{"metadata": {"b": 1, "a": ["x", "y"], "é": None, "Z": []}}, {"metadata": [{"key": "k", "value": ["v"]}, {"key": "a", "value": 2}]}]}),
    ("ChangeFact", {"changes": {"review": {"approvals": {"reviewer": "r"}}, "verificationEvidence": ["e"]}}),
    ("SyntaxFact", {"tree": {"kind": "a", "children": [{"kind": "b", "modifiers": ["m"], "children": {"kind": "c"}}]}}),
    ("TestSuiteFact", {"strict_controls": {}, "markers": "[1, 2]"}),
    ("DataAssetFact", {"assets": [["a", None], [], {"fields": [[1], 2, {"tags": {"x": 1}}]}]}),
    ("Unknown", {"assets": [1]}),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "fact_id string, family string, payload string").withColumn("value", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("relation", F.lit("x"))


def test_cases(spark):
    deep = {"kind": "leaf"}
    for k in range(30):
        deep = {"kind": f"n{k}", "children": [deep, {"kind": "side", "modifiers": ["m", "n"]}]}
    cases = [*CASES, ("SyntaxFact", {"tree": deep})]
    rows = [(f"f{k}", family, json.dumps(p)) for k, (family, p) in enumerate(cases)]
    rows += [(f"f{k}", family, json.dumps(json.dumps(p))) for k, (family, p) in enumerate(cases)]
    rows += [("n", "DataAssetFact", None), ("e", "DataAssetFact", ""), ("t", "DataAssetFact", '{"assets": ['), ("l", "DataAssetFact", "[]"), ("x", None, "{}")]
    got = {tuple(r) for r in nested.entries(frame(spark, rows)).select(*COLUMNS).distinct().collect()}
    want = set().union(*(brute.nested_rows(*r) for r in rows))
    assert got == want


def test_empty(spark):
    assert nested.entries(frame(spark, [])).count() == 0


@needs_data
def test_whole_table(spark):
    raw = spark.read.parquet(f"{DATA}/raw_fact.parquet")
    got = {tuple(r) for r in nested.entries(raw).select(*COLUMNS).distinct().collect()}
    assert got == set().union(*(brute.nested_rows(r.fact_id, r.family, r.payload) for r in raw.select("fact_id", "family", "payload").collect()))


def test_typed(spark):
    rows = [(1, "a", "DataAssetFact", "r", "p", "python", json.dumps(CASES[0][1]), None, None), (2, "a", "DataAssetFact", "r", "p", "python", "{", None, None)]
    raw = spark.createDataFrame(rows, "delivery_id long, fact_id string, family string, repository string, path string, language string, payload string, observed_at timestamp, ingested_at timestamp")
    table = payloads.table(raw, "DataAssetFact")
    assert [r["identifier"] for r in table.relation("assets").collect()] == ["a", None]
    with pytest.raises(KeyError):
        table.relation("fields")
