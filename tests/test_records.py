"""Rules over declared records and judged rules, and the builder of fact tables from nested records."""

import pytest
from factloom import rules  # noqa: F401  registers the catalog
from factloom.operators.facts import record_table
from factloom.plans import engine

FULL = dict(condition="c", severity="s", impact="i", owner="o", destination="d", action="a", runbook="r")
ALERT = "name string, enabled boolean, audience string, condition string, severity string, impact string, owner string, destination string, action string, runbook string"


def made(spark, family, schema, *rows):
    return record_table(family, spark.createDataFrame([(f"f{k}", *r) for k, r in enumerate(rows)], f"fact_id string, {schema}"))


def values(table, id, **settings):
    result = engine.evaluate(engine.CATALOG[id], {table.family: table}, settings)
    rows = {r.fact_id: next((v for v in (r.integer_value, r.boolean_value, r.float_value, r.category_value) if v is not None), None) for r in result.values.collect()}
    if result.findings is not None:
        result.findings.collect()
    return rows


def test_record_tables(spark):
    table = made(spark, "X", "xs array<struct<a:string,b:int>>, tags array<string>", ([("p", 1), (None, 2)], ["t"]), ([], None), (None, []))
    assert [tuple(r) for r in table.relation("xs").orderBy("fact_id", "ordinal").select("fact_id", "ordinal", "a", "b").collect()] == [("f0", 0, "p", 1), ("f0", 1, None, 2)]
    assert set(table.facts().columns) >= {"fact_order", "path", "start_line", "language", "tags"} and "xs" not in table.facts().columns
    assert table.facts().count() == 3
    assert record_table("X", spark.createDataFrame([], "fact_id string, xs array<struct<a:string>>")).facts().count() == 0


CASES = [
    ("AlertFact", f"alerts array<struct<{ALERT.replace(' string', ':string').replace(' boolean', ':boolean')}>>", "ALL-OBSE0002", [([("a", True, "paging", *FULL.values()), ("b", True, "paging", " ", *list(FULL.values())[1:]), ("c", False, "paging", *[""] * 7), ("d", True, "informational", *[""] * 7)],), ([],)], {"f0": 50.0, "f1": 0.0}),
    ("DependencyFact", "dependencies array<struct<name:string,is_development:boolean,resolved_release_day:long,latest_compatible_release_day:long,project_state:string,repository_state:string,resolved_release_state:string>>", "ALL-DEPE0001", [([("a", False, 10, 20, "active", "active", "available"), ("b", False, 10, 900, "active", "active", "available"), ("c", True, 1, 999, None, None, None), ("d", False, None, 3, None, None, None)],)], {"f0": 50.0}),
    ("DependencyFact", "dependencies array<struct<name:string,project_state:string,repository_state:string,resolved_release_state:string>>", "ALL-DEPE0002", [([("a", "archived", None, None), ("b", None, "archived", None), ("c", None, None, "yanked"), ("d", "active", "active", "available")],)], {"f0": 3}),
    ("DependencyFact", "dependencies array<struct<name:string,resolved_release_day:long,latest_compatible_release_day:long>>", "ALL-DEPE0004", [([("a", 1, 2), ("b", None, 2), ("c", 1, None), ("d", 3, 3)],)], {"f0": 50.0}),
    ("DataFieldReferenceFact", "references array<struct<asset_identifier:string,field_name:string,asset_exists:boolean,field_exists:boolean,expected_type:string,catalog_type:string>>", "ALL-DATA0002", [([("a", "x", True, False, "", ""), ("b", "x", False, False, "", ""), ("a", "y", True, True, " Int ", "int")],)], {"f0": 1}),
    ("DataFieldReferenceFact", "references array<struct<asset_identifier:string,field_name:string,asset_exists:boolean,field_exists:boolean,expected_type:string,catalog_type:string>>", "ALL-DATA0003", [([("a", "x", True, True, "int", "text"), ("a", "y", True, True, " Int ", "int"), ("a", "z", True, True, "", "int")],)], {"f0": 1}),
    ("FeatureFlagFact", "flags array<struct<name:string,age_days:long,role:string,owner:string,decision_due_days:long,cleanup_plan:string>>", "ALL-LIFE0002", [([("a", 100, "", "", None, ""), ("b", 100, "operational", "", None, ""), ("c", 5, "", "", -1, ""), ("d", 100, "", "o", None, "p"), ("e", 5, "", "", 3, "")],)], {"f0": 2}),
    ("ServiceObjectiveFact", "services array<struct<name:string,in_scope:boolean,user_facing:boolean,owner:string,user_journeys:array<string>,indicators:array<string>,objectives:array<string>,windows:array<string>,error_budget_policy:string>>", "ALL-OBSE0003", [([("a", True, True, "o", ["j"], ["i"], ["x"], ["w"], "p"), ("b", True, True, "o", ["j"], [""], ["x"], ["w"], "p"), ("c", False, True, "", [], [], [], [], "")],)], {"f0": 50.0}),
    ("RunbookFact", "triggers array<struct<name:string,in_scope:boolean,owner:string,commands:array<string>,verification_age_days:long,self_healing:boolean,design_evidence:string>>", "ALL-OPER0001", [([("a", True, "o", ["c"], 3, False, ""), ("b", True, "", [], None, True, "doc"), ("c", True, "o", ["c"], 400, False, ""), ("d", True, "o", ["c"], None, False, "")],)], {"f0": 50.0}),
    ("ArchitectureCharacteristicFact", "characteristics array<struct<name:string,objective:string,check:string,owner:string,scope:string,observation_age_days:long,verification:string>>", "ALL-ARCH0001", [([("a", "o", "c", "w", "s", 3, "ci"), ("b", "o", "c", "w", "s", 3, "manual"), ("c", "o", "c", "w", "s", None, "ci"), ("d", "o", "c", "w", "s", 99, "ci")],)], {"f0": 25.0}),
    ("ModuleMetricFact", "module string, afferent_count long, declaration_count long, abstract_declaration_count long", "ALL-ARCH0005", [("a", 0, 4, 2), ("b", 1, 4, 4), ("c", 0, 4, 1), ("d", 0, 0, 0)], {"f0": True, "f1": False, "f2": False, "f3": False}),
    ("InteropFact", "name string, declared_language string, references array<struct<path:string,language:string,line:long>>", "ALL-BIND0001", [("a", "rust", [("x.py", "python", 1)]), ("b", "rust", [("x.rs", "rust", 1), ("c.toml", "toml", 1)]), ("c", "rust", [])], {"f0": False, "f1": True, "f2": True}),
    ("InteropFact", "name string, declared_language string, references array<struct<path:string,language:string,line:long>>", "ALL-BIND0002", [("a", "rust", [("x.py", "python", 1), ("y.py", "python", 1), ("z.ts", "typescript", 2), ("c.toml", "toml", 1)])], {"f0": 2}),
    ("CIConfigurationFact", "workflows array<struct<name:string,tasks:array<string>,is_change_blocking:boolean,uses_locked_dependencies:boolean,has_explicit_permissions:boolean>>", "ALL-CI0001", [([("w", ["lint", "test"], True, True, True), ("v", ["typecheck"], True, True, True)],), ([("w", ["lint", "typecheck", "test"], False, True, True)],), ([("w", ["lint"], True, True, True)],), ([],)], {"f0": "complete", "f1": "fragile", "f2": "partial", "f3": "absent"}),
    ("DeploymentFact", "is_applicable boolean, locked_inputs array<string>, build_command string, environment string, artifact_identity string, secrets_boundary string, rollback_command string, configuration_sources array<string>, provenance string", "ALL-DEPL0001", [(True, ["l"], "b", "e", "a", "s", "r", ["c"], "p"), (True, [], "b", "", "", "", "", [], ""), (True, [], " ", "", "", "", "", None, None), (False, [], "", "", "", "", "", [], "")], {"f0": "reproducible", "f1": "partial", "f2": "nonreproducible", "f3": "not_applicable"}),
    ("RepositoryCloneFact", "repository_line_count long, fragments array<struct<path:string,start_line:long,end_line:long>>", "ALL-DUPL0004", [(100, [("a", 1, 10), ("b", 5, 14)]), (100, [("a", 1, 2), ("b", 1, 2)]), (0, [("a", 1, 9), ("b", 1, 9)])], {"f0": 10.0, "f1": 0.0, "f2": 0.0}),
    ("DirectoryFact", "files long, directories long", "ALL-FILE0001", [(0, 0), (1, 0), (0, 2)], {"f0": True, "f1": False, "f2": False}),
    ("AutomationTaskFact", "tasks array<struct<capability:string,commands:array<string>,guidance_locations:array<string>,is_repository_owned:boolean,is_noninteractive:boolean>>", "ALL-LIFE0001", [([(t, ["x"], [], True, True) for t in ("setup", "lint", "typecheck", "test")],), ([("setup", ["x", "y"], [], True, True)],), ([],)], {"f0": False, "f1": True, "f2": True}),
    ("AutomationTaskFact", "tasks array<struct<capability:string,commands:array<string>,guidance_locations:array<string>,is_repository_owned:boolean,is_noninteractive:boolean>>", "ALL-ONBO0001", [([("setup", ["x"], ["g"], True, True), ("test", ["x"], [], True, True)],)], {"f0": 25.0}),
    ("PerformanceDecisionFact", "budgets array<struct<name:string,is_critical:boolean,metric:string,limit:string,workload:string,environment:string,check:string,owner:string>>", "ALL-PERF0001", [([("a", True, *"mlweco"), ("b", True, *"mlwec", ""), ("c", False, *[""] * 6)],)], {"f0": 50.0}),
    ("QuarantineFact", "quarantined array<struct<name:string,age_days:long,owner:string,has_remediation_evidence:boolean,recurred_after_repair:boolean>>", "ALL-TEST0002", [([("a", 3, "o", True, False), ("b", 30, "o", True, False), ("c", 3, "", True, False), ("d", 3, "o", False, False), ("e", 3, "o", True, True), ("f", None, "o", True, False)],)], {"f0": 5}),
    ("AuthorshipSignalFact", "matches array<struct<provider:string,matched_text:string,is_eligible:boolean>>", "ALL-WRIT0001", [([("p", "x", True), ("q", "y", True), ("p", "z", False)],)], {"f0": 2}),
    ("RouteFact", "routes array<struct<method:string,path:string,declared_in:string,line:long,is_prefix_composed:boolean,references:array<struct<path:string>>>>", "ALL-ROUT0001", [([("GET", "/a", "x.py", 1, False, []), ("GET", "/a", "y.py", 2, False, []), ("PUT", "/a", "x.py", 3, False, [])],)], {"f0": 2}),
    ("RouteFact", "routes array<struct<method:string,path:string,declared_in:string,line:long,is_prefix_composed:boolean,references:array<struct<path:string>>>>", "ALL-ROUT0002", [([("GET", "/a", "x.py", 1, False, [("x.py",)]), ("GET", "/b", "y.py", 2, False, [("z.ts",)]), ("PUT", "/c", "x.py", 3, True, [])],)], {"f0": 1}),
    ("RouteFact", "routes array<struct<method:string,path:string,declared_in:string,line:long>>", "ALL-ROUT0003", [([("GET", "/a-b/c-d", "x.py", 1), ("GET", "/a_b/{x_y}", "y.py", 2)],), ([("GET", "/a-b", "x.py", 1), ("GET", "/a_b", "y.py", 2)],)], {"f0": 1, "f1": 0}),
    ("RepositoryChangeFact", "changes array<struct<paths:array<string>>>, files array<struct<path:string,imports:array<string>>>", "ALL-HIST0003", [([(["a.py", "b.py"],)] * 5 + [(["a.py", "c.py"],)] * 5 + [(["a.py", "d.py"],)] * 2, [("a.py", ["c"]), ("b.py", None)])], {"f0": 1}),
    ("InitializerFact", "initializers array<struct<name:string,line:long,base_has_initializer:boolean,calls_base:boolean,strangers:array<string>,hidden_methods:array<string>>>", "ALL-OVER0006", [([("A", 1, True, False, [], []), ("B", 2, True, True, ["X", "Y"], ["m"]), ("C", 3, False, False, [], [])],)], {"f0": 1}),
    ("InitializerFact", "initializers array<struct<name:string,line:long,base_has_initializer:boolean,calls_base:boolean,strangers:array<string>,hidden_methods:array<string>>>", "ALL-OVER0007", [([("B", 2, True, True, ["X", "Y"], ["m"])],)], {"f0": 2}),
    ("InitializerFact", "initializers array<struct<name:string,line:long,base_has_initializer:boolean,calls_base:boolean,strangers:array<string>,hidden_methods:array<string>>>", "ALL-OVER0010", [([("B", 2, True, True, ["X", "Y"], ["m"])],)], {"f0": 1}),
    ("SuiteConfigurationFact", "language string, asyncio_mode string, anyio_mode string", "PY-TEST0006", [("python", "auto", "auto"), ("python", "auto", None)], {"f0": True, "f1": False}),
    ("SuiteConfigurationFact", "language string, coverage_enabled boolean, coverage_branch boolean", "PY-TEST0007", [("python", True, None), ("python", True, True), ("python", None, None)], {"f0": True, "f1": False, "f2": False}),
    ("ProjectTargetFact", "language string, targets array<struct<tool:string,target:string>>", "PY-TYPE0003", [("python", [("a", ">=3.14"), ("b", "py314"), ("c", "py313"), ("d", "3.12")])], {"f0": 2}),
]


@pytest.mark.parametrize("family,schema,id,rows,want", CASES, ids=[c[2] for c in CASES])
def test_records(spark, family, schema, id, rows, want):
    assert values(made(spark, family, schema, *rows), id) == want


def test_judged_rules_ask_and_answer(spark):
    table = made(spark, "CloneGroupFact", "token_length long, fragments array<struct<path:string,lines:array<string>>>", (90, [("a", ["x"]), ("b", ["x"])]), (10, [("a", ["x"])]))
    asked = engine.evaluate(engine.CATALOG["ALL-DUPL1001"], {"CloneGroupFact": table})
    assert {r.fact_id: r.category_value for r in asked.values.collect()} == {"f0": None}
    assert asked.findings.collect()[0].choice_options == ["similar_shape", "intentional_boundary", "shared_knowledge", "uncertain"]
    seen = []

    def backend(texts):
        assert all('"rows":2' in t for t in texts)
        return [("shared_knowledge", 0.9)] * len(texts)

    assert values(table, "ALL-DUPL1001", backend=backend) == {"f0": "shared_knowledge"} and not seen
    summary = engine.run(spark, {"CloneGroupFact": table}, engine.Options(select=["ALL-DUPL1001"])).summaries.first()
    assert (summary.observation_count, summary.unassessed_count, summary.failure_count) == (1, 1, 0)


def test_every_judged_rule_is_declared():
    from factloom.rules.judgments import QUESTIONS

    assert len({q.id for q in QUESTIONS}) == len(QUESTIONS) == 44
    for q in QUESTIONS:
        assert len(set(q.answers)) == len(q.answers) and "uncertain" in q.answers and q.id in engine.CATALOG


def test_comments_that_are_code(spark):
    from factloom.sources import domain

    bodies = [("a.py", "# x = f(1)"), ("a.py", "# just a note"), ("a.py", "# note"), ("a.py", "# if a:\n#     b()"), ("b.rs", "// let x = 1;\n// f(x);"), ("b.rs", "// The end; of it"), ("b.rs", ""), ("b.rs", "// f(;")]
    groups = spark.createDataFrame([(k, "r", p, b, None, 1, 1, None) for k, (p, b) in enumerate(bodies)], "group_id long, repository string, path string, body string, kind string, line_count long, start_line long, ingested_at timestamp")
    table = domain.parsed_comment_table(groups)
    assert values(table, "ALL-COMM0002") == {"comments:r:a.py": 2, "comments:r:b.rs": 1}
