"""Rules whose value is a category that someone has to judge: a model, a person, or a table of earlier answers.

Each rule names its candidates, what of them is shown, a question and the closed list of answers. With a backend the
candidates are answered in batches (see `context.classify`); without one every candidate stays unassessed and its
finding carries the question and the answers, so that a later run or a reader can settle it. A fact that is no candidate
has no value. The rules are declared as data, since they differ in nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..context import classify
from ..operators.facts import FactTable
from ..plans import shaping
from ..plans.contracts import Result
from ..plans.engine import rule

#: Rows of a relation a question shows of one fact.
SHOWN = 200


@dataclass(frozen=True)
class Question:
    """id, family and what is asked. where: SQL condition on the facts (settings may stand in it in braces); shown: columns of the
    facts (those a table lacks show as null); relation: a child relation of which every row is shown, with its columns."""

    id: str
    name: str
    family: str
    asked: str
    bad: tuple[str, ...] = ()
    good: tuple[str, ...] = ()
    neutral: tuple[str, ...] = ("uncertain",)
    where: str = "true"
    shown: tuple[str, ...] = ("fact_id", "path")
    relation: str = ""
    columns: tuple[str, ...] = ()
    language: str | None = None
    settings: tuple[tuple[str, object], ...] = ()

    @property
    def answers(self) -> tuple[str, ...]:
        return (*self.good, *self.bad, *self.neutral)


_CLASS = ("path", "name", "bases", "decorators", "methods", "public_methods", "fields")
_METHODS = ("name", "visibility", "is_static", "reads_state", "positional")
_FUNCTION = ("path", "qualname", "statements", "conditionals", "nesting", "operations", "decorators", "docstring")
_PARAMETERS = ("name", "annotation", "kind", "has_default")

# Ids, names and answers of the judged rules.
QUESTIONS = [
    Question("ALL-ABST1001", "abstraction_quality", "ClassFact", "Does this class lower the complexity its users meet?", ("leaky", "premature", "wrong", "missing"), ("useful",), shown=_CLASS, relation="methods", columns=_METHODS),
    Question("ALL-ARCH1001", "module_cohesion", "ModuleFact", "Do the module's declarations serve one outcome?", ("mixed",), ("cohesive", "intentional_integration"), where="functions + classes >= {minimum_members}", shown=("path", "line_count", "functions", "classes"), settings=(("minimum_members", 4),)),
    Question("ALL-ARCH1002", "dependency_boundary_alignment", "ModuleCouplingFact", "Do the dependencies respect the boundaries between packages?", ("leaky",), ("aligned", "intentional_bridge"), relation="edges", columns=("source", "target"), settings=(("boundary_depth", 1),)),
    Question("ALL-ARCH1003", "dependency_hub_quality", "ModuleCouplingFact", "Are the modules most others depend on fit to be hubs?", ("dependency_magnet",), ("stable_abstraction", "intentional_coordinator"), relation="edges", columns=("source", "target")),
    Question("ALL-ARCH1004", "mixed_class_responsibilities", "ClassFact", "Does the class hold unrelated responsibilities?", ("mixed",), ("cohesive", "intentional_coordinator"), where="methods >= {minimum_methods}", shown=_CLASS, relation="methods", columns=_METHODS, settings=(("minimum_methods", 4),)),
    Question("ALL-ARCH1005", "change_locality", "ChangeFact", "Did one intent stay in one place of the system?", ("scattered",), ("localized", "intentional_protocol_change"), ("transient", "uncertain"), relation="changes", columns=("identifier", "author")),
    Question("ALL-ARCH1006", "maintenance_hotspot", "RepositoryHistoryFact", "Do often changed and large files cost upkeep?", ("hotspot",), ("healthy", "stable_complex"), ("transient", "uncertain"), relation="files", columns=("path", "author_count", "additional_commit_count", "line_count")),
    Question("ALL-ARCH1007", "component_balance", "ModuleCouplingFact", "Are sibling packages of like weight?", ("oversized", "fragmented", "asymmetric"), ("balanced",), relation="edges", columns=("source", "target")),
    Question("ALL-CLAS1001", "inheritance_design", "OverrideFact", "Is the class a kind of its base?", ("composition",), ("subtype", "mixin", "framework"), where="ancestors > 0", shown=("class_id", "ancestors")),
    Question("ALL-CLAS1002", "substitutability", "OverrideFact", "Can the class stand wherever its base does?", ("narrowed", "weakened", "refused"), ("preserved",), where="ancestors > 0", shown=("class_id", "ancestors")),
    Question("ALL-COMM1001", "comment_intent", "CommentFact", "What do the comments tell the reader?", ("restatement", "todo", "disabled_code"), ("rationale", "contract", "warning"), ("historical", "uncertain"), relation="groups where token_count >= {minimum_tokens}", columns=("body", "kind"), settings=(("minimum_tokens", 3),)),
    Question("ALL-COMM1002", "comment_accuracy", "CommentFact", "Do the comments agree with the code beside them?", ("stale", "ambiguous"), ("current", "historical"), relation="groups where token_count >= {minimum_tokens}", columns=("body", "kind"), settings=(("minimum_tokens", 3),)),
    Question("ALL-DEPL1001", "progressive_rollout", "DeploymentFact", "Is a release exposed in verified steps?", ("partial", "unsafe"), ("verified", "not_needed"), shown=("environment", "build_command", "rollback_command")),
    Question("ALL-DEPL1002", "exposure_control", "DeploymentFact", "Is the reach of a release bounded?", ("partial", "unbounded"), ("controlled", "not_required"), shown=("environment", "configuration_sources", "secrets_boundary")),
    Question("ALL-DEPL1003", "rollout_success_criteria", "DeploymentFact", "Do stated measures decide whether a release goes on?", ("incomplete", "misaligned", "absent"), ("decisive",), shown=("environment", "provenance")),
    Question("ALL-DEPL1004", "rollback_readiness", "DeploymentFact", "Can the release be taken back in time?", ("partial", "unverified", "blocked"), ("ready", "not_required"), shown=("rollback_command", "migrations")),
    Question("ALL-DESI1001", "primitive_obsession", "FunctionFact", "Do plain values stand where the domain has a concept?", ("overmodeled",), ("appropriate", "domain_model", "modeled", "value_object"), where="is_public", shown=_FUNCTION, relation="parameters", columns=_PARAMETERS),
    Question("ALL-DESI1002", "design_pattern_fit", "ClassFact", "Does a pattern fit the problem of this class?", ("missing", "premature", "misapplied"), ("useful", "not_needed"), shown=_CLASS, relation="methods", columns=_METHODS),
    Question("ALL-DESI1003", "extension_design", "ClassFact", "Can likely changes be added without editing this class?", ("rigid", "speculative"), ("extensible", "intentionally_closed"), shown=_CLASS, relation="methods", columns=_METHODS),
    Question("ALL-DUPL1001", "semantic_duplication", "CloneGroupFact", "Do the copies encode the same knowledge?", ("shared_knowledge",), ("similar_shape", "intentional_boundary"), where="token_length >= {minimum_tokens}", shown=("token_length",), relation="fragments", columns=("path", "lines"), settings=(("minimum_tokens", 80),)),
    Question("ALL-FUNC1001", "abstraction_level", "FunctionFact", "Does the function stay on one level of abstraction?", ("mixed",), ("cohesive", "boundary"), where="statements > 1", shown=_FUNCTION),
    Question("ALL-FUNC1002", "effect_visibility", "FunctionFact", "Does the name tell the effects of the function?", ("hidden",), ("explicit", "purposeful"), shown=_FUNCTION),
    Question("ALL-INTE1001", "interface_segregation", "ClassFact", "Do users need all that the class offers?", ("bloated", "fragmented"), ("focused", "facade"), where="public_methods > 1", shown=_CLASS, relation="methods", columns=_METHODS),
    Question("ALL-OBSE1001", "diagnostic_context", "ModuleFact", "Do the log calls say what a responder needs?", ("sparse", "noisy", "unsafe"), ("actionable",), relation="call where callee rlike '(?i)(?:^|[.])log(?:ger|ging)?[.](?:warning|error|exception|critical)$'", columns=("callee", "first", "line")),
    Question("ALL-OBSE1002", "operational_risk_coverage", "OperationalRiskFact", "Would the known risks be noticed and acted on?", ("gaps", "noisy", "unsafe"), ("actionable",)),
    Question("ALL-PERF1001", "profiling_evidence", "PerformanceDecisionFact", "Does a profile carry the decision?", ("stale", "incomplete", "absent"), ("sufficient", "not_needed"), relation="budgets", columns=("name",)),
    Question("ALL-PERF1002", "optimization_justification", "PerformanceDecisionFact", "Do measurements justify the optimization?", ("unsupported", "regression"), ("supported", "not_applicable"), relation="budgets", columns=("name",)),
    Question("ALL-PERF1003", "benchmark_quality", "PerformanceDecisionFact", "Does the benchmark stand for real use?", ("micro_only", "uncontrolled", "stale"), ("representative", "not_needed"), relation="budgets", columns=("name",)),
    Question("ALL-PERF1004", "algorithmic_complexity", "FunctionFact", "Does the work grow as the input allows?", ("risky", "avoidable"), ("proportionate",), ("tradeoff", "uncertain"), where="nesting > 1 OR is_recursive", shown=_FUNCTION),
    Question("ALL-RELI1003", "bounded_work", "FunctionFact", "Is queued or concurrent work bounded?", ("unbounded", "dropped"), ("bounded", "backpressured"), where="is_async", shown=_FUNCTION),
    Question("ALL-REVI1001", "change_reviewability", "ChangeFact", "Can one reviewer judge the change as a whole?", ("entangled", "oversized", "incomplete"), ("focused", "mechanical"), relation="changes", columns=("identifier", "author")),
    Question("ALL-SECU1002", "vulnerability_response_readiness", "SecurityBoundaryFact", "Would a reported weakness be handled in time?", ("partial", "absent", "stale"), ("ready", "not_required")),
    Question("ALL-SECU1003", "threat_model_coverage", "SecurityBoundaryFact", "Does a threat model cover this boundary?", ("gaps", "stale", "misaligned"), ("complete", "inherited", "not_required")),
    Question("ALL-STAT1001", "state_ownership", "ClassFact", "Does one place own the state of the class?", ("shared", "leaked"), ("owned", "immutable"), where="fields > 0", shown=_CLASS, relation="methods", columns=_METHODS),
    Question("ALL-STAT1002", "temporal_coupling", "ClassFact", "Must the methods be called in an order nothing enforces?", ("hidden", "avoidable"), ("explicit", "intrinsic"), where="methods > 1", shown=_CLASS, relation="methods", columns=_METHODS),
    Question("ALL-STRI1001", "string_construction_mechanism", "ModuleFact", "Which mechanism builds the long texts best?", (), (), ("literal", "f_string", "string_template", "join", "f_string_join", "uncertain"), relation="literal where length(text) >= {minimum_characters}", columns=("text", "role", "fragments"), settings=(("minimum_characters", 80),)),
    Question("ALL-TEST1001", "test_strategy", "TestStrategyFact", "Do the levels of tests fit the risks?", ("gaps", "overbuilt", "misaligned"), ("sufficient",)),
    Question("ALL-TEST1002", "test_isolation", "TestStrategyFact", "Do tests stay apart from each other?", ("overmocked",), ("isolated", "integrated"), ("shared", "uncertain")),
    Question("ALL-WRIT1001", "comment_language", "CommentFact", "Are the comments written in {target_language}?", ("other",), ("target",), relation="groups where character_count >= {minimum_characters}", columns=("body",), settings=(("target_language", "American English"), ("minimum_characters", 24))),
    Question("ALL-WRIT1002", "docstring_language", "ProseSegmentFact", "Is the text written in {target_language}?", ("other",), ("target",), relation="sections where length(text) >= {minimum_characters}", columns=("text",), settings=(("target_language", "American English"), ("minimum_characters", 24))),
    Question("PY-INTE1001", "python_interface_form", "ClassFact", "Which form should this interface have?", (), (), ("concrete", "protocol", "abc", "callable", "duck", "uncertain"), where="is_public", shown=_CLASS, relation="methods", columns=_METHODS, language="python"),
    Question("PY-MODE1001", "model_foundation", "ClassFact", "Which foundation fits this model?", ("use_frozen_model", "use_model", "use_flex_model", "use_frozen_flex_model", "use_plain_class"), ("appropriate", "dataclass_exception"), where="fields > 0", shown=_CLASS, language="python"),
    Question("PY-MODE1002", "shared_model_placement", "ClassFact", "Does this model belong to a shared place?", ("move_to_shared_boundary",), ("keep_with_owner",), where="fields > 0", shown=_CLASS, language="python", settings=(("minimum_importers", 2),)),
    Question("PY-TYPE1001", "shared_typing_placement", "ModuleFact", "Do the type definitions of this module belong to a shared one?", ("move_to_shared_module",), ("keep_with_owner",), shown=("path", "classes"), relation="annotation", columns=("text", "line"), language="python", settings=(("minimum_definitions", 5), ("minimum_imported_definitions", 3), ("minimum_cross_module_imports", 3))),
]


def candidates(table: FactTable, q: Question, settings: dict) -> tuple[DataFrame, DataFrame]:
    """The facts a question is asked of, and fact_id and JSON text of what is shown of each.

    A fact of a rule with a relation is a candidate if it has a row there. The number of its rows is shown, and the first
    SHOWN in the order of their texts: a question has to fit a reader, and no group of rows grows beyond that.
    """
    facts = table.facts().where(q.where.format(**settings))
    shown = lambda columns, have: [(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in columns]
    records = None
    if q.relation:
        name, _, condition = q.relation.partition(" where ")
        rows = table.relation(name)
        if condition:
            rows = rows.where(condition.format(**settings))
        rows = rows.select("fact_id", F.to_json(F.struct(*shown(q.columns, rows.columns))).alias("_row"))
        first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("fact_id").orderBy("_row"))).where(F.col("_k") <= SHOWN)
        held = first.groupBy("fact_id").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
        records = F.struct(F.col("_n").alias("rows"), F.col("_rows").alias("first"))
        facts = facts.join(held, "fact_id").join(rows.groupBy("fact_id").agg(F.count("*").alias("_n")), "fact_id")
    fields = facts.select("*", F.struct(*shown(q.shown, facts.columns)).alias("_shown"))
    return facts, classify.candidates(fields, ["_shown"], records)


def judge(table: FactTable, q: Question, backend: classify.Backend | None = None, **settings) -> Result:
    facts, asked = candidates(table, q, settings)
    if backend is not None:
        return classify.result(facts, classify.classified(asked, backend, q.answers))
    findings = shaping.findings(facts, F.lit(q.asked.format(**settings)), order=F.lit(0), question=F.lit(q.asked.format(**settings)), options=q.answers)
    return shaping.category(facts, F.lit(None), findings, F.lit(1))


def _register(q: Question) -> None:
    settings = dict(q.settings)
    policy = classify.policy(q.answers, q.good, q.neutral)

    def build(table: FactTable, backend: classify.Backend | None = None, **given) -> Result:
        return judge(table, q, backend, **(settings | given))

    build.__name__, build.__doc__ = q.name, q.asked
    rule(q.id, q.family, output="category", policy=policy, language=q.language)(build)


for _q in QUESTIONS:
    _register(_q)
