"""Rules over declared records: dependencies, fields, deployments, automation, flags, alerts, objectives, runbooks, artifacts, routes.

Their families come as nested records (see `operators.facts.record_table`). A blank text counts as absent everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.facts import FactTable, all_of, any_of, filled
from ..plans import shaping
from ..plans.contracts import Category, Numeric, Result
from ..plans.engine import rule
from .shape import counted, covered, flag, text

_SHARE = {"output": "float", "policy": Numeric(minimum=95)}


def _some(name: str) -> Column:
    """Whether a list of texts has one that is not blank."""
    return F.exists(F.coalesce(F.col(name), F.array().cast("array<string>")), filled)


def _fresh(age: str, most: int) -> Column:
    return F.col(age).isNotNull() & (F.col(age) <= most)


def _named(*names: str) -> Column:
    return all_of(*(filled(F.col(n)) for n in names))


@rule("ALL-ARCH0001", "ArchitectureCharacteristicFact", **_SHARE)
def architecture_fitness_coverage(facts: FactTable, require_ci: bool = True, maximum_age_days: int = 30) -> Result:
    """Percentage of declared characteristics with an objective, a check, a fresh result, an owner and a scope."""
    checked = (F.col("verification") == "ci") if require_ci else (F.col("verification") != "none")
    met = _named("objective", "check", "owner", "scope") & _fresh("observation_age_days", maximum_age_days) & checked
    return covered(facts, facts.relation("characteristics"), met, text("`", F.col("name"), "` is not guarded"))


@rule("ALL-ARCH0005", "ModuleMetricFact", output="boolean")
def abstraction_nothing_depends_on(modules: FactTable, minimum_abstractness: float = 0.5) -> Result:
    """A module that is mostly abstract and that no other depends on."""
    share = F.col("abstract_declaration_count") / F.nullif(F.col("declaration_count"), F.lit(0))
    return flag(modules, (share >= minimum_abstractness) & (F.col("afferent_count") == 0), text("nothing depends on `", F.col("module"), "`"))


@rule("ALL-BIND0001", "InteropFact", output="boolean")
def unreached_cross_language_artifact(artifacts: FactTable) -> Result:
    """A declared artifact that no other language names."""
    reached = artifacts.relation("references").join(artifacts.facts().select("fact_id", "declared_language"), "fact_id").where(~F.col("language").isin("toml", "json", "yaml") & (F.col("language") != F.col("declared_language"))).select("fact_id", F.lit(True).alias("_reached")).distinct()
    table = FactTable("InteropFact", {"facts": artifacts.facts().join(reached, "fact_id", "left")})
    return flag(table, F.col("_reached").isNull(), text("`", F.col("name"), "` is not reached"))


@rule("ALL-BIND0002", "InteropFact", policy=Numeric(maximum=1))
def cross_language_boundary_width(artifacts: FactTable, manifests: tuple[str, ...] = ("toml", "json", "yaml")) -> Result:
    """The number of other languages that name an artifact; manifests do not count."""
    rows = artifacts.relation("references").join(artifacts.facts().select("fact_id", "declared_language"), "fact_id").where(~F.col("language").isin(*manifests) & (F.col("language") != F.col("declared_language")))
    return counted(artifacts, rows.groupBy("fact_id", "language").agg(F.min("path").alias("path"), F.min("line").alias("line")), text("named from ", F.col("language")))


@rule("ALL-CI0001", "CIConfigurationFact", output="category", policy=Category(frozenset({"complete"}), frozenset({"partial"}), frozenset({"fragile", "absent"})))
def continuous_integration(facts: FactTable, required_tasks: tuple[str, ...] = ("lint", "typecheck", "test")) -> Result:
    """absent without a workflow; complete if blocking workflows with locked inputs have every task; fragile if none of them blocks; else partial."""
    rows = facts.relation("workflows")
    sound = F.col("is_change_blocking") & F.col("uses_locked_dependencies") & F.col("has_explicit_permissions")
    tasks = rows.groupBy("fact_id").agg(F.count("*").alias("_n"), F.max(F.col("is_change_blocking").cast("int")).alias("_blocking"), F.array_distinct(F.flatten(F.collect_set(F.when(sound, F.col("tasks"))))).alias("_tasks"))
    missing = F.array_except(F.array(*map(F.lit, required_tasks)), F.coalesce("_tasks", F.array().cast("array<string>")))
    value = F.when(F.col("_n").isNull(), "absent").when(F.size(missing) == 0, "complete").when(F.col("_blocking") == 0, "fragile").otherwise("partial")
    return shaping.category(facts.facts().join(tasks, "fact_id", "left"), value)


@rule("ALL-DATA0002", "DataFieldReferenceFact")
def missing_data_field_reference(references: FactTable) -> Result:
    """Fields read from an asset that exists and lacks them."""
    return counted(references, references.relation("references").where("asset_exists AND NOT field_exists"), text("`", F.col("asset_identifier"), "` has no field `", F.col("field_name"), "`"))


@rule("ALL-DATA0003", "DataFieldReferenceFact")
def incompatible_data_field_type(references: FactTable) -> Result:
    """Fields whose stated type is not the catalog's, blanks and case aside."""
    plain = lambda c: F.lower(F.trim(c))
    rows = references.relation("references").where(_named("expected_type", "catalog_type") & F.col("field_exists") & (plain("expected_type") != plain("catalog_type")))
    return counted(references, rows, text("`", F.col("field_name"), "` is ", F.col("catalog_type")))


def _dependencies(facts: FactTable, include_development: bool) -> DataFrame:
    rows = facts.relation("dependencies")
    return rows if include_development else rows.where(~F.coalesce("is_development", F.lit(False)))


@rule("ALL-DEPE0001", "DependencyFact", **_SHARE)
def dependency_technical_lag(facts: FactTable, maximum_release_lag_days: int = 180, include_development: bool = False) -> Result:
    """Percentage of dependencies with known releases that lag the latest compatible one by no more than a limit."""
    rows = _dependencies(facts, include_development).where("resolved_release_day IS NOT NULL AND latest_compatible_release_day IS NOT NULL")
    lag = F.col("latest_compatible_release_day") - F.col("resolved_release_day")
    return covered(facts, rows, lag <= maximum_release_lag_days, text("`", F.col("name"), "` lags by ", lag, " days"))


@rule("ALL-DEPE0002", "DependencyFact")
def explicit_dependency_state_count(facts: FactTable, include_yanked: bool = True) -> Result:
    """Dependencies that are archived, deprecated, quarantined or yanked."""
    states = [F.col("project_state").isin("archived", "deprecated", "quarantined"), F.col("repository_state") == "archived"]
    return counted(facts, facts.relation("dependencies").where(any_of(*states, *([F.col("resolved_release_state") == "yanked"] if include_yanked else []))), text("`", F.col("name"), "` is no longer kept"))


@rule("ALL-DEPE0004", "DependencyFact", output="float", policy=Numeric(maximum=5))
def dependency_evidence_gap_percentage(facts: FactTable) -> Result:
    """Percentage of dependencies without release evidence."""
    rows = facts.relation("dependencies")
    gap = F.col("resolved_release_day").isNull() | F.col("latest_compatible_release_day").isNull()
    return shaping.floating(facts.coverage(rows, gap, "gap"), "gap", shaping.findings(shaping.located(rows.where(gap)), text("`", F.col("name"), "` has no release evidence")))


@rule("ALL-DEPL0001", "DeploymentFact", output="category", policy=Category(frozenset({"reproducible"}), frozenset({"not_applicable"}), frozenset({"partial", "nonreproducible"})))
def deployment_reproducibility(facts: FactTable, require_provenance: bool = True) -> Result:
    """reproducible if every check is met, nonreproducible if none is, else partial."""
    checks = [_some("locked_inputs"), *(filled(F.col(c)) for c in ("build_command", "environment", "artifact_identity", "secrets_boundary", "rollback_command")), _some("configuration_sources"), *([filled(F.col("provenance"))] if require_provenance else [])]
    met = sum((c.cast("int") for c in checks), F.lit(0))
    value = F.when(~F.coalesce("is_applicable", F.lit(True)), "not_applicable").when(met == len(checks), "reproducible").when(met == 0, "nonreproducible").otherwise("partial")
    return shaping.category(facts.facts(), value)


@rule("ALL-DUPL0004", "RepositoryCloneFact", output="float", policy=Numeric(maximum=3))
def duplicated_repository_share(clones: FactTable, minimum_line_count: int = 4) -> Result:
    """Lines a clone group's further copies repeat, in percent of the repository's lines."""
    size = F.col("end_line") - F.col("start_line") + 1
    groups = clones.relation("fragments").groupBy("fact_id").agg(F.count("*").alias("_n"), F.max(size).alias("_lines"), F.sum(size).alias("_all"))
    table = clones.facts().join(groups, "fact_id", "left")
    value = F.when((F.col("_n") > 1) & (F.col("_lines") >= minimum_line_count), (F.col("_all") - F.col("_lines")) * 100.0 / F.nullif(F.col("repository_line_count"), F.lit(0))).otherwise(0.0)
    return shaping.floating(table, F.coalesce(value, F.lit(0.0)))


@rule("ALL-FILE0001", "DirectoryFact", output="boolean")
def empty_directories(directories: FactTable) -> Result:
    """A directory that holds nothing."""
    return flag(directories, (F.col("files") == 0) & (F.col("directories") == 0), text("`", F.col("path"), "` is empty"))


def _automated(tasks: DataFrame) -> DataFrame:
    """fact_id, capability and the number of its owned, noninteractive commands, with guidance."""
    usable = F.col("is_repository_owned") & F.col("is_noninteractive") & (F.size(F.filter("commands", filled)) == 1)
    return tasks.groupBy("fact_id", "capability").agg(F.sum(usable.cast("int")).alias("_usable"), F.max(_some("guidance_locations").cast("int")).alias("_guided"))


@rule("ALL-LIFE0001", "AutomationTaskFact", output="boolean")
def project_automation(facts: FactTable, required_tasks: tuple[str, ...] = ("setup", "lint", "typecheck", "test")) -> Result:
    """Whether a required task lacks exactly one owned command that asks nothing."""
    met = _automated(facts.relation("tasks")).where("_usable = 1").groupBy("fact_id").agg(F.collect_set(F.when(F.col("capability").isin(*required_tasks), F.col("capability"))).alias("_met"))
    table = FactTable("AutomationTaskFact", {"facts": facts.facts().join(met, "fact_id", "left")})
    return flag(table, F.size(F.coalesce("_met", F.array().cast("array<string>"))) < len(set(required_tasks)), text("a required task has no single command"))


@rule("ALL-ONBO0001", "AutomationTaskFact", **_SHARE)
def onboarding_readiness(facts: FactTable, required_capabilities: tuple[str, ...] = ("setup", "test", "architecture", "debug")) -> Result:
    """Percentage of the capabilities a newcomer needs that have one owned command and guidance."""
    wanted = facts.facts().select("fact_id", "path", F.explode(F.array(*map(F.lit, required_capabilities))).alias("capability"))
    rows = wanted.join(_automated(facts.relation("tasks")), ["fact_id", "capability"], "left")
    return covered(facts, rows, (F.col("_usable") == 1) & (F.col("_guided") == 1), text("`", F.col("capability"), "` is not ready"))


@rule("ALL-LIFE0002", "FeatureFlagFact")
def feature_flag_debt(facts: FactTable, maximum_age_days: int = 90, permanent_labels: tuple[str, ...] = ("operational", "permission")) -> Result:
    """Flags that are old or overdue and have no owner or no plan to remove them."""
    late = (F.col("age_days") > maximum_age_days) | F.coalesce(F.col("decision_due_days") < 0, F.lit(False))
    return counted(facts, facts.relation("flags").where(~F.col("role").isin(*permanent_labels) & late & ~_named("owner", "cleanup_plan")), text("`", F.col("name"), "` is overdue"))


@rule("ALL-OBSE0002", "AlertFact", **_SHARE)
def alert_actionability(facts: FactTable) -> Result:
    """Percentage of enabled paging alerts that state all a responder needs."""
    rows = facts.relation("alerts").where("enabled AND audience = 'paging'")
    return covered(facts, rows, _named("condition", "severity", "impact", "owner", "destination", "action", "runbook"), text("`", F.col("name"), "` cannot be acted on"))


@rule("ALL-OBSE0003", "ServiceObjectiveFact", **_SHARE)
def service_objective_coverage(facts: FactTable) -> Result:
    """Percentage of user-facing services in scope with complete objectives."""
    met = _named("owner", "error_budget_policy") & all_of(*map(_some, ("user_journeys", "indicators", "objectives", "windows")))
    return covered(facts, facts.relation("services").where("in_scope AND user_facing"), met, text("`", F.col("name"), "` has no complete objective"))


@rule("ALL-OPER0001", "RunbookFact", **_SHARE)
def runbook_coverage(facts: FactTable, maximum_age_days: int = 90) -> Result:
    """Percentage of triggers in scope with an owned, recently verified runbook, or a designed self-healing."""
    met = (_named("owner") & _some("commands") & _fresh("verification_age_days", maximum_age_days)) | (F.col("self_healing") & filled(F.col("design_evidence")))
    return covered(facts, facts.relation("triggers").where("in_scope"), met, text("`", F.col("name"), "` has no verified runbook"))


@rule("ALL-PERF0001", "PerformanceDecisionFact", **_SHARE)
def regression_guard_coverage(facts: FactTable) -> Result:
    """Percentage of critical budgets with a metric, limit, workload, environment, check and owner."""
    return covered(facts, facts.relation("budgets").where("is_critical"), _named("metric", "limit", "workload", "environment", "check", "owner"), text("`", F.col("name"), "` is not guarded"))


@rule("ALL-TEST0002", "QuarantineFact")
def flaky_test_quarantine_debt(facts: FactTable, maximum_age_days: int = 14, require_owner: bool = True) -> Result:
    """Quarantined tests that are too old, unowned, came back, or have no remedy."""
    bad = any_of(~_fresh("age_days", maximum_age_days), *([~_named("owner")] if require_owner else []), F.col("recurred_after_repair"), ~F.col("has_remediation_evidence"))
    return counted(facts, facts.relation("quarantined").where(bad), text("`", F.col("name"), "` is left in quarantine"))


@rule("ALL-WRIT0001", "AuthorshipSignalFact")
def ai_associated_pattern_count(facts: FactTable, providers: tuple[str, ...] = ()) -> Result:
    """Eligible matches, of given providers or of all."""
    rows = facts.relation("matches").where("is_eligible")
    return counted(facts, rows.where(F.col("provider").isin(*providers)) if providers else rows, text("`", F.col("matched_text"), "`"))


# --- routes


@rule("ALL-ROUT0001", "RouteFact")
def duplicate_route_declaration(facts: FactTable) -> Result:
    """Declarations of a method and path that another place declares too."""
    rows = facts.relation("routes")
    many = rows.groupBy("fact_id", "method", "path").agg(F.count("*").alias("n")).where("n > 1")
    return counted(facts, rows.join(many.drop("n"), ["fact_id", "method", "path"]).withColumn("route", F.col("path")), text("`", F.col("method"), " ", F.col("route"), "` is declared twice"))


@rule("ALL-ROUT0002", "RouteFact")
def unreached_declared_route(facts: FactTable) -> Result:
    """Routes no other file names."""
    other = F.exists(F.coalesce("references", F.array().cast("array<struct<path:string>>")), lambda r: r["path"] != F.col("declared_in"))
    return counted(facts, facts.relation("routes").where(~other & ~F.coalesce("is_prefix_composed", F.lit(False))), text("nothing names `", F.col("path"), "`"))


@rule("ALL-ROUT0003", "RouteFact")
def inconsistent_route_path_style(facts: FactTable) -> Result:
    """Segments that part words the way the minority of the segments does; placeholders do not vote, a tie has no minority."""
    parts = facts.relation("routes").select("fact_id", "ordinal", "path", F.explode(F.split("path", "/")).alias("segment")).where("segment <> '' AND NOT segment RLIKE '[{<:]'")
    style = F.when(F.col("segment").contains("-") & ~F.col("segment").contains("_"), "-").when(F.col("segment").contains("_") & ~F.col("segment").contains("-"), "_")
    voted = parts.withColumn("style", style).where("style IS NOT NULL")
    votes = voted.groupBy("fact_id").agg(F.sum((F.col("style") == "-").cast("int")).alias("_dash"), F.sum((F.col("style") == "_").cast("int")).alias("_bar"))
    minority = votes.select("fact_id", F.when(F.col("_dash") < F.col("_bar"), "-").when(F.col("_bar") < F.col("_dash"), "_").alias("style"))
    return counted(facts, voted.join(minority, ["fact_id", "style"]), text("`", F.col("segment"), "` is styled unlike the others"))


# --- history, overrides


@rule("ALL-HIST0003", "RepositoryChangeFact")
def coupled_files_that_never_name_each_other(facts: FactTable, minimum_shared_commits: int = 5, minimum_confidence: float = 0.5, maximum_commit_files: int = 30) -> Result:
    """Pairs of files that change together often, measured against the rarer one, and of which neither imports the other."""
    changes = facts.relation("changes").where(F.size("paths") <= maximum_commit_files)
    ones = changes.select("fact_id", "ordinal", F.array_sort(F.array_distinct("paths")).alias("paths"))
    times = ones.select("fact_id", F.explode("paths").alias("file")).groupBy("fact_id", "file").agg(F.count("*").alias("n"))
    pair = F.flatten(F.transform("paths", lambda a: F.transform(F.filter("paths", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    shared = ones.select("fact_id", F.explode(pair).alias("p")).groupBy("fact_id", "p.left", "p.right").agg(F.count("*").alias("shared")).where(F.col("shared") >= minimum_shared_commits)
    rows = shared.join(times.toDF("fact_id", "left", "n_left"), ["fact_id", "left"]).join(times.toDF("fact_id", "right", "n_right"), ["fact_id", "right"])
    rows = rows.where(F.col("shared") / F.least("n_left", "n_right") >= minimum_confidence)
    names = facts.relation("files").select("fact_id", F.col("path").alias("file"), F.explode("imports").alias("named"))
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.[^./]+$", ""), "/", ".")
    linked = names.select("fact_id", "file", F.regexp_replace("named", "/", ".").alias("named"))
    for a, b in (("left", "right"), ("right", "left")):
        rows = rows.withColumn("_stem", stem(F.col(b))).join(linked.select("fact_id", F.col("file").alias(a), F.col("named").alias("_stem")).distinct(), ["fact_id", a, "_stem"], "left_anti").drop("_stem")
    return counted(facts, rows.withColumn("path", F.col("left")), text("`", F.col("left"), "` and `", F.col("right"), "` change together"))


@rule("ALL-OVER0006", "InitializerFact")
def subclass_initializer_skips_its_base(classes: FactTable) -> Result:
    """Initializers of a class whose base has one too and which they never call."""
    return counted(classes, classes.relation("initializers").where("base_has_initializer AND NOT calls_base"), text("`", F.col("name"), "` leaves its base uninitialised"))


@rule("ALL-OVER0007", "InitializerFact")
def initializer_called_on_a_stranger(classes: FactTable) -> Result:
    """Initializers of classes that are no ancestors, called from an initializer."""
    rows = classes.relation("initializers").select("fact_id", "ordinal", "path", "line", "name", F.explode("strangers").alias("stranger"))
    return counted(classes, rows, text("`", F.col("stranger"), "` is no base of `", F.col("name"), "`"))


@rule("ALL-OVER0010", "InitializerFact")
def inherited_attribute_hides_a_method(classes: FactTable) -> Result:
    """Methods whose name the base binds as data."""
    rows = classes.relation("initializers").select("fact_id", "ordinal", "path", "line", "name", F.explode("hidden_methods").alias("method"))
    return counted(classes, rows, text("`", F.col("method"), "` is data in the base of `", F.col("name"), "`"))


# --- suites and projects


@rule("PY-TEST0006", "SuiteConfigurationFact", output="boolean", language="python")
def async_runner_auto_mode_conflict(suites: FactTable) -> Result:
    """Two asynchronous runners that both take every test."""
    return flag(suites, (F.col("asyncio_mode") == "auto") & (F.col("anyio_mode") == "auto"), text("two runners claim the same tests"))


@rule("PY-TEST0007", "SuiteConfigurationFact", output="boolean", language="python")
def coverage_without_branch_measurement(suites: FactTable) -> Result:
    """Coverage that counts lines and no branches."""
    return flag(suites, F.col("coverage_enabled") & ~F.coalesce("coverage_branch", F.lit(False)), text("branches are not measured"))


@rule("PY-TYPE0003", "ProjectTargetFact", language="python")
def minimum_python_declaration(projects: FactTable, minimum_version: str = "3.14") -> Result:
    """Tools whose Python version is not the stated least one."""
    number = F.regexp_replace(F.regexp_replace("target", r"^\D*", ""), r"^(\d)(\d+)$", "$1.$2")
    return counted(projects, projects.relation("targets").where(F.regexp_extract(number, r"^\d+\.\d+", 0) != minimum_version), text("`", F.col("tool"), "` targets ", F.col("target")))


@rule("ALL-STRI0002", "StringExpressionFact")
def decorative_repeated_separator_count(facts: FactTable, minimum_repetitions: int = 3) -> Result:
    """Literals that repeat a separator sign a fixed number of times."""
    return counted(facts, facts.relation("separators").where(F.col("repetitions") >= minimum_repetitions), text("`", F.col("sign"), "` is repeated ", F.col("repetitions"), " times"))
