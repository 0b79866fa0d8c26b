"""Rules over tests, reach, surfaces, devices, lineage, changes and coupling."""

import textwrap

import pytest
from factloom import rules  # noqa: F401  registers the catalog
from factloom.operators.facts import FactTable
from factloom.plans import engine
from factloom.sources import domain, python_source, surfaces

IDENTITY = "fact_order long, fact_id string, path string, start_line long, start_column long, end_line long, end_column long, language string"


def value(tables, id):
    rows = engine.evaluate(engine.CATALOG[id], tables).values.collect()
    return {r.fact_id: r.integer_value if r.float_value is None else round(r.float_value, 6) for r in rows if (r.integer_value or r.float_value)}


@pytest.fixture(scope="module")
def suite(spark):
    cases = "".join(f"def test_{k}(tmpdir):\n    assert lib.run({k}) == {k}\n\n" for k in range(4))
    same = "".join(f"def test_same_{k}():\n    assert other.go(1)\n\n" for k in range(2))
    sources = {
        "app/tests/test_a.py": "import lib\nSTATE = 0\n" + cases + same + textwrap.dedent('''
            import torch, cuda
            def test_loop():
                global STATE
                for x in [1, 2, 3]:
                    assert x
            @pytest.mark.parametrize("n", range(0, 50))
            def test_range(n):
                if n:
                    if n > 2:
                        pass
                assert n
            def helper(t):
                s = cuda.Stream()
                cuda.synchronize()
                cuda.to_device(t)
                return torch.relu(torch.exp(t)), t.cpu().numpy()
            '''),
        "app/enums/kind.py": "from enum import StrEnum\nclass Kind(StrEnum):\n    RED = 'red'\n    BLUE = 'azure'\nclass Two(StrEnum):\n    A = 'a'\n",
        "app/shared.py": "__all__ = ['used', 'unused']\ndef used(): pass\ndef unused(): pass\ndef local(): pass\nlocal()\nclass AppError(Exception): pass\n",
        "app/x.py": "from app.shared import used, AppError\n", "app/y/z.py": "from ..shared import AppError\nused()\n",
    }
    frame = spark.createDataFrame([(k, p, t, None) for k, (p, t) in enumerate(sources.items())], "file_id long, path string, text string, ingested_at timestamp")
    return python_source.tables(frame)


@pytest.mark.parametrize("id,want", [
    ("PY-TEST0002", {"module:app/tests/test_a.py": 4}), ("PY-TEST0003", {"module:app/tests/test_a.py": 1}), ("PY-TEST0008", {"module:app/tests/test_a.py": 1}), ("PY-TEST0011", {"module:app/tests/test_a.py": 2}),
    ("PY-TEST0013", {"module:app/tests/test_a.py": 1}), ("PY-TEST0014", {"module:app/tests/test_a.py": 1}), ("PY-TEST0015", {"module:app/tests/test_a.py": 1}), ("PY-ENUM0001", {"module:app/enums/kind.py": 2}), ("PY-ENUM0004", {"module:app/enums/kind.py": 1}),
    ("ALL-REAC0002", {"module:app/shared.py": 1}), ("PY-MODU0005", {"module:app/shared.py": 1}), ("PY-EXCE0003", {"module:app/shared.py": 1}), ("PY-IMPO0001", {"module:app/x.py": 2}),
    ("PY-CUDA0003", {"module:app/tests/test_a.py": 1}), ("PY-NUMB0005", {"module:app/tests/test_a.py": 1}), ("PY-NUMB0007", {"module:app/tests/test_a.py": 1}), ("PY-PERF0001", {"module:app/tests/test_a.py": 1}), ("PY-TORC0001", {"module:app/tests/test_a.py": 1}),
])
def test_suites_reach_and_devices(suite, id, want):
    assert value(suite, id) == want


def test_unreferenced(suite):
    names = {r.message for r in engine.evaluate(engine.CATALOG["ALL-REAC0001"], suite).findings.collect()}
    assert "nothing names `unused`" in names and "nothing names `used`" not in names


def test_surfaces(spark):
    rust = "fn a<'a>(x: &'a str) -> &'a str { x }\nfn b<'a>(x: &'a A, y: &'a B) {}\nfn c(x: &'static str) { for i in x { y.clone(); } z.clone(); }\n// x.clone()\nfn d(s: &str) { \"&'static .clone()\" }"
    ts = "export * from './a';\nimport { b } from '../../b';\nenum E { A }\nconst x = y as any; // @ts-ignore\nnamespace N { }\n"
    frame = spark.createDataFrame([(1, "a.rs", rust, None), (2, "b.ts", ts, None), (2, "b.ts", ts, None), (3, "c.ts", "", None), (4, "d.rs", None, None)], "file_id long, path string, text string, ingested_at timestamp")
    tables = surfaces.tables(frame)
    assert value(tables, "RS-LIFE0001") == {"file:a.rs": 1} and value(tables, "RS-LIFE0002") == {"file:a.rs": 1} and value(tables, "RS-LIFE0003") == {"file:a.rs": 2}
    assert value(tables, "RS-OWNE0001") == {"file:a.rs": 1} and value(tables, "RS-OWNE0002") == {"file:a.rs": 2}
    assert value(tables, "TS-MODU0001") == {"file:b.ts": 1} and value(tables, "TS-MODU0002") == {"file:b.ts": 2} and value(tables, "TS-TYPE0001") == {"file:b.ts": 2}
    assert value(tables, "TS-TYPE0002") == {"file:b.ts": round(100 / 6, 6)}


def _table(spark, family, relation, rows, schema, facts=("f",)):
    own = spark.createDataFrame([(k, f, f"{f}.py", 1, 0, 1, 0, None) for k, f in enumerate(facts)], IDENTITY)
    return FactTable(family, {"facts": own, relation: spark.createDataFrame(rows, schema)})


def test_lineage_and_changes(spark):
    edges = _table(spark, "LineageEdgeFact", "edges", [("f", 0, "a", "b", True, True), ("f", 1, "b", "c", True, False), ("f", 2, "c", "d", False, False), ("f", 3, "c", "a", True, True)], "fact_id string, ordinal long, source string, target string, source_exists boolean, target_exists boolean")
    assets = _table(spark, "DataAssetFact", "assets", [("f", 0, "a", [" "]), ("f", 1, "b", ["x"]), ("f", 2, "d", None)], "fact_id string, ordinal long, identifier string, owners array<string>")
    assert value({"LineageEdgeFact": edges}, "ALL-DATA0010") == {"f": 3}
    assert value({"LineageEdgeFact": edges, "DataAssetFact": assets}, "ALL-DATA0011") == {"f": 1}
    changes = _table(spark, "DataChangeFact", "changes", [("f", 0, "a", True, ["b", "c", "b"], ["b"]), ("f", 1, "z", False, ["q"], None)], "fact_id string, ordinal long, asset_identifier string, is_breaking boolean, downstream_assets array<string>, tested_assets array<string>")
    assert value({"DataChangeFact": changes}, "ALL-DATA0008") == {"f": round(200 / 3, 6)}
    checks = _table(spark, "CICheckFact", "checks", [("f", "a", True, [100, 200, 700]), ("f", "b", True, [1, 2]), ("f", "c", False, [9000])], "fact_id string, name string, required boolean, durations array<long>")
    assert value({"CICheckFact": checks}, "ALL-CI0002") == {"f": 50.0}


def test_coupling_and_history(spark):
    classes = spark.createDataFrame([("1", "r", "a.x", ["b.y", "c.z"], None, None), ("2", "r", "b.y", ["a.x", None], ["1"], None), ("3", "r", "c.z", None, None, ["2"]), ("4", "q", "m", [], ["4"], None)], "class_id string, repository string, module string, importers array<string>, bases array<string>, subclasses array<string>")
    tables = {"ModuleCouplingFact": domain.coupling_table(classes), "OverrideFact": domain.override_table(classes)}
    assert value(tables, "ALL-ARCH0002") == {"coupling:r": 1}
    ancestors = {r.fact_id: r.integer_value for r in engine.evaluate(engine.CATALOG["ALL-CLAS0005"], tables).values.collect()}
    assert ancestors == {"class:1": 0, "class:2": 1, "class:3": 0, "class:4": None}
    files = spark.createDataFrame([("r", "a", 5, 5, 10, 500, None), ("r", "b", 1, None, 10, 900, None), ("r", "a", 1, 0, 10, 1, None), ("s", "c", None, None, None, None, None)], "repository string, path string, author_count long, additional_commit_count long, days_since_last_change long, line_count long, recorded_at timestamp")
    history = {"RepositoryHistoryFact": domain.history_table(files)}
    assert value(history, "ALL-HIST0001") == {"history:r": 1} and value(history, "ALL-HIST0002") == {"history:r": 1}
