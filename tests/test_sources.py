"""History from logs, providers, dependency releases and artifacts across languages."""

import json

import pytest
from factloom import rules  # noqa: F401  registers the catalog
from factloom.operators.facts import record_table
from factloom.plans import engine
from factloom.sources import git_log, interop, providers
from pyspark.sql import functions as F

LOG = """stray
\x01c1\x02ann\x02100000
A\ta.py
A\tb.py

\x01c2\x02bob\x02200000
R090\ta.py\tc.py
M\tb.py
\x01c3\x02ann\x02300000
R100\tc.py\td/e.py
D\tb.py
\x01c4\x02ann\x02400000
M\td/e.py
X\tz.py"""


@pytest.mark.parametrize("block", [git_log.BLOCK, 3, 1])
def test_log_with_renames(spark, block):
    rows = [("r", k, line) for k, line in enumerate(LOG.split("\n"))]
    log = spark.createDataFrame(rows + rows[:4] + [("r", None, None)], "repository string, line_no long, line string")
    found = git_log.changes(log, block)
    assert {(r.commit, r.status, r.path, r.former) for r in found.collect()} == {("c1", "A", "a.py", None), ("c1", "A", "b.py", None), ("c2", "R", "c.py", "a.py"), ("c2", "M", "b.py", None), ("c3", "R", "d/e.py", "c.py"), ("c3", "D", "b.py", None), ("c4", "M", "d/e.py", None)}
    history = git_log.history(git_log.folded(found), F.timestamp_seconds(F.lit(400000 + 86400 * 2))).collect()
    assert [tuple(r) for r in history] == [("r", "d/e.py", 2, 2, 2)]
    assert git_log.history(git_log.folded(git_log.changes(log.limit(0))), F.current_timestamp()).count() == 0


def test_providers(spark, tmp_path):
    schema = "fact_id string, alerts array<struct<name:string,enabled:boolean>>"
    for name, rows in (("one", [{"fact_id": "a", "alerts": [{"name": "x", "enabled": True}], "made_up": 1}]), ("two", [{"fact_id": "a", "alerts": []}, {"fact_id": "b", "alerts": [{"name": "y"}, {"name": "z"}]}, {"alerts": []}])):
        (tmp_path / name / "AlertFact").mkdir(parents=True)
        (tmp_path / name / "AlertFact" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    made = providers.tables(spark, [providers.Recorded(n, str(tmp_path / n), {"AlertFact": schema}) for n in ("one", "two")])
    assert {(r.fact_id, r.provider) for r in made["AlertFact"].facts().collect()} == {("a", "one"), ("b", "two")}
    assert {(r.fact_id, r.ordinal, r.name) for r in made["AlertFact"].relation("alerts").collect()} == {("a", 0, "x"), ("b", 0, "y"), ("b", 1, "z")}

    class Short:
        name, families = "short", {"X": "fact_id string, a int"}

        def read(self, session, family):
            return session.createDataFrame([("f",)], "fact_id string")

    with pytest.raises(ValueError):
        providers.tables(spark, [Short()])


def test_releases(spark):
    pins = spark.createDataFrame([("m", "a", "1.0", None), ("m", "a", "1.0", None), ("m", "b", "2.0", True), ("m", "gone", "1", False)], "fact_id string, name string, version string, is_development boolean")
    releases = spark.createDataFrame([("a", "1.0", 1, 10, False), ("a", "1.5", 1, 300, False), ("a", "1.6", 1, 400, True), ("a", "2.0", 2, 500, False), ("b", "2.0", 2, 5, True)], "name string, version string, major int, day long, is_yanked boolean")
    table = record_table("DependencyFact", providers.dependency_records(pins, releases))
    got = {r.name: (r.resolved_release_day, r.latest_compatible_release_day, r.resolved_release_state) for r in table.relation("dependencies").collect()}
    assert got == {"a": (10, 300, "available"), "b": (5, 5, "yanked"), "gone": (None, None, "unknown")}
    assert [r.float_value for r in engine.evaluate(engine.CATALOG["ALL-DEPE0001"], {"DependencyFact": table}).values.collect()] == [0.0]


def test_artifacts(spark):
    files = [
        ("core/Cargo.toml", '[package]\nname = "core"\n[[bin]]\nname = "core-tool"\n[lib]\nname = "corelib"\n'), ("core/src/lib.rs", "#[pymodule]\nfn fastpath(m: &M) {}\n"), ("k.cu", "__global__ void blur(float* a) {}\n"), ("pyproject.toml", '[project.scripts]\nserve = "app:main"\n'),
        ("app.py", "import fastpath\nrun('core-tool')\nfastpath.x\n"), ("run.ts", "spawn('core-tool')"), ("x.rs", "corelib::f()"), ("no.md", "blur"), ("e.py", ""), ("n.py", None),
    ]
    frame = spark.createDataFrame([("r", p, t) for p, t in files] * 2, "repository string, path string, text string")
    found = {r.name: (r.mechanism, r.declared_language, [(x.path, x.line) for x in r.references]) for r in interop.artifacts(frame).collect()}
    assert found["core-tool"] == ("binary", "rust", [("app.py", 2), ("run.ts", 1)]) and found["fastpath"] == ("native-module", "rust", [("app.py", 1)])
    assert found["blur"] == ("kernel", "cuda", []) and found["serve"] == ("console-script", "python", []) and found["corelib"][0] == "shared-library"
    table = record_table("InteropFact", interop.artifacts(frame))
    value = lambda id, kind: {r.fact_id.rsplit(":", 1)[-1]: getattr(r, kind) for r in engine.evaluate(engine.CATALOG[id], {"InteropFact": table}).values.collect()}
    assert value("ALL-BIND0001", "boolean_value") == {"core-tool": False, "corelib": True, "fastpath": False, "blur": True, "serve": True}
    assert value("ALL-BIND0002", "integer_value")["core-tool"] == 2
    assert interop.artifacts(frame.limit(0)).count() == 0
