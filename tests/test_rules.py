import textwrap

import pytest
from factloom import rules  # noqa: F401  registers the catalog
from factloom.plans import engine
from factloom.sources import python_source, repository

SOURCES = {
    "pkg/app.py": '''
        import os, json
        import hashlib
        from ._hidden import thing
        from __future__ import annotations

        LIMIT = 3

        def work(a: str, b: str, flag: bool = False, config=None):
            """Does work"""
            if a == "x":
                return 1
            elif a == "y":
                return 2
            elif a == "z":
                return 3
            for i in range(3):
                while flag:
                    if config.one and config.two:
                        print(hashlib.md5(b"x"))
            try:
                x = 1
                raise ValueError("bad")
            except ValueError:
                pass
            try:
                os.system("ls")
            except Exception as error:
                raise RuntimeError("lost")
            password = "hunter2hunter2"
            a == b
            return other._private

        async def spawn():
            asyncio.create_task(one())
            await asyncio.gather(two())

        def _unused():
            return 1
        ''',
    "pkg/shapes.py": '''
        from typing import final

        class Base:
            def area(self, scale, unit="m"):
                return 0

            @final
            def name(self):
                return "b"

        class Square(Base):
            def _z(self): return 1
            def area(self, size):
                return 1

            def name(self):
                return "s"

            def __init__(self):
                self.x = 1

        class Same(Base):
            pass
        ''',
    "pkg/broken.py": "def (",
    "pkg/pkg.py": "__all__ = []\n",
}
WANT = {
    "ALL-BRAN0001": {"pkg/app.py": 1}, "ALL-CONT0002": {"pkg/app.py": 1}, "ALL-CONT0003": {"pkg/app.py": 1}, "ALL-ERRO0001": {"pkg/app.py": 1}, "ALL-ERRO0002": {"pkg/app.py": 1}, "ALL-ERRO0004": {"pkg/app.py": 1},
    "ALL-SECU0002": {"pkg/app.py": 1}, "ALL-SECU0004": {"pkg/app.py": 1}, "ALL-SECU0005": {"pkg/app.py": 1}, "ALL-ENCA0001": {"pkg/app.py": 1}, "PY-IMPO0002": {"pkg/app.py": 1}, "PY-CONS0001": {"pkg/app.py": 1},
    "PY-TYPE0001": {"pkg/app.py": 1}, "PY-EXCE0001": {"pkg/app.py": 1}, "ALL-PARA0001": {"pkg/app.py": 1}, "ALL-PARA0002": {"pkg/app.py": 1}, "ALL-PARA0003": {"pkg/app.py": 1}, "ALL-OVER0001": {"pkg/shapes.py": 1},
    "ALL-OVER0002": {"pkg/shapes.py": 1}, "ALL-OVER0008": {"pkg/shapes.py": 1}, "PY-IMPO0003": {"pkg/app.py": 2},
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(k, p, textwrap.dedent(t), None) for k, (p, t) in enumerate(SOURCES.items())] + [(90, "a.rs", "fn", None), (91, "n.py", None, None), (0, "pkg/app.py", textwrap.dedent(SOURCES["pkg/app.py"]), None)]
    return python_source.tables(spark.createDataFrame(rows, "file_id long, path string, text string, ingested_at timestamp"))


@pytest.mark.parametrize("id", sorted(WANT))
def test_rule(tables, id):
    values = engine.evaluate(engine.CATALOG[id], tables).values
    got = {r.path: r.v for r in values.groupBy("path").agg({"integer_value": "sum"}).toDF("path", "v").collect()}
    for path, n in WANT[id].items():
        assert got[path] == n, (id, got)


def test_flags(tables):
    def failing(id, column="boolean_value"):
        return {r.fact_id.split(":")[2] for r in engine.evaluate(engine.CATALOG[id], tables).values.where(column).collect()}

    assert failing("PY-DEAD0001") == {"_unused"}
    assert failing("PY-ASYN0002") == {"spawn"}
    assert failing("PY-CLAS0006") == {"Same"}
    assert failing("PY-DOCU0001") == {"work"}


def test_secrets_are_never_shown(tables):
    found = engine.evaluate(engine.CATALOG["ALL-SECU0004"], tables).findings.collect()
    assert found and not any("hunter2" in str(r) for r in found)


def test_complexity(tables):
    values = engine.evaluate(engine.CATALOG["ALL-FUNC0009"], tables).values.collect()
    assert {r.fact_id.split(":")[2]: r.integer_value for r in values}["work"] == 3


def test_all_rules_in_one_run(spark, tables):
    some = ["ALL-MODU0001", "ALL-MODU0002", "ALL-FUNC0001", "ALL-FUNC0008", "ALL-CONT0004", "PY-IMPO0003", "PY-MODU0004"]
    report = engine.run(spark, tables, engine.Options(select=some, limit=5))
    assert report.summaries.count() == len(some)
    assert report.rewrites.count() == 2 and report.nodes.count() == 2


def test_walk_and_directories(spark, tmp_path):
    for name in ("a/b/c.py", "a/b/d.py", "node_modules/x.py", "a/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    files = repository.walk(spark, str(tmp_path), "o/n")
    assert {r.path for r in files.collect()} == {"a/b/c.py", "a/b/d.py"}
    found = repository.directories(files)
    assert {(r.directory, r.files, r.directories) for r in found.collect()} == {("a", 0, 1), ("a/b", 2, 0)}
    assert [r.directory for r in repository.pathways(found).collect()] == ["a"]
    assert repository.fingerprint(files).first()["files"] == 2


def test_diagram(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "source string, target string")
    assert repository.node_link(edges).count("-->") == 2 and "->" in repository.node_link(edges, "d2")


def test_shared_scans_give_the_same_results(spark, tables):
    some = ["ALL-BRAN0001", "ALL-CONT0002", "ALL-ERRO0001", "ALL-SECU0002", "ALL-CALL0001", "PY-CONS0001", "ALL-MODU0001", "ALL-MODU0003", "ALL-MODU0005", "ALL-FUNC0008", "PY-DEAD0001", "ALL-TEST0003", "ALL-PARA0001"]
    only = spark.createDataFrame([("pkg/app.py",), ("pkg/pkg.py",)], "path string")
    for paths in (None, only):
        options = engine.Options(select=some, limit=None, paths=paths, policies={"ALL-SECU0002": None})
        one, two = (engine.run(spark, tables, options, fuse=f) for f in (True, False))
        for name, keys in (("summaries", ["rule", "observation_count", "unassessed_count", "failure_count", "finding_count"]), ("failures", ["rule", "fact_id", "integer_value", "boolean_value", "finding_count", "path"]), ("findings", ["rule", "fact_id", "finding_order", "message", "start_line", "measurement_values"])):
            a, b = (sorted(map(str, getattr(r, name).select(*keys).collect())) for r in (one, two))
            assert a == b, name


def test_long_texts_are_judged_whole(spark):
    long, other = "word " * 600, "x" * 300
    sources = {
        "a.py": f"def f(n, x, api_key=None):\n    s = '{long}a'\n    token = g('{other}', random.random())\n    password = '{other} your password'\n    secret = '{other}'\n",
        "b.py": f"s = '{long}b'\nt = '{long}same'\nu = from_numpy(g('{other}').get())\n", "c.py": f"s = '{long}c'\nt = '{long}same'\n", "d.py": f"t = '{long}same'\n",
        "e.py": "".join(f"cast('{other}{k % 4}', x)\n" for k in range(6)), "f.py": f"cast('{other}', x)\n" * 3,
    }
    found = python_source.tables(spark.createDataFrame([(k, p, t, None) for k, (p, t) in enumerate(sources.items())], "file_id long, path string, text string, ingested_at timestamp"))

    def value(id):
        return {r.path: r.integer_value for r in engine.evaluate(engine.CATALOG[id], found).values.collect() if r.integer_value}

    assert value("ALL-DUPL0002") == {"b.py": 1, "c.py": 1, "d.py": 1}
    assert value("PY-TYPE0005") == {"f.py": 3}
    assert value("ALL-SECU0003") == {"a.py": 1}
    assert value("ALL-SECU0004") == {"a.py": 1}
    assert value("PY-PERF0001") == {"b.py": 1}
