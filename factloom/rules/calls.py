"""Rules over calls."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..operators.facts import FactTable, any_of
from ..plans.contracts import Result
from ..plans.engine import rule
from .shape import counted, counted_where, text

# Callables the rules look for.
REFLECTIVE = ("locals", "vars", "globals", "eval", "exec")
DEBUG = ("print", "pprint", "breakpoint", "pdb.set_trace", "ic")
WEAK_HASHES = ("hashlib.md5", "hashlib.sha1", "md5", "sha1")
WEAK_NAMES = r"(?i)^['\"](?:md5|sha-?1|md4|md2)['\"]$"
SHELLS = ("os.system", "os.popen", "subprocess.getoutput", "subprocess.getstatusoutput")


def _calls(modules: FactTable, condition: Column, message: Column) -> Result:
    return counted_where(modules, "call", condition, message)


def _named(*names: str) -> Column:
    return F.col("callee").isin(*names)


@rule("ALL-CALL0001", "ModuleFact")
def unchecked_result_call(modules: FactTable, checked_callables: tuple[str, ...] = (), checked_prefixes: tuple[str, ...] = ()) -> Result:
    """A call whose result must be checked and is dropped."""
    must = any_of(*([F.col("callee").isin(*checked_callables)] if checked_callables else []), *(F.col("callee").startswith(p) for p in checked_prefixes))
    return _calls(modules, F.col("discarded") & must, text("the result of `", F.col("callee"), "` is dropped"))


@rule("ALL-CALL0002", "ModuleFact")
def unbounded_blocking_call(modules: FactTable, bounded_callables: tuple[str, ...] = (), bound_names: tuple[str, ...] = ("timeout", "deadline", "duration")) -> Result:
    """A call of a listed blocking callable without a bound among its keywords; none is listed by default."""
    return _calls(modules, (F.col("callee").isin(*bounded_callables) if bounded_callables else F.lit(False)) & ~F.arrays_overlap("keywords", F.array(*map(F.lit, bound_names))), text("`", F.col("callee"), "` may never return"))


@rule("ALL-CONT0003", "ModuleFact")
def debug_artifact_left_behind(modules: FactTable, artifacts: tuple[str, ...] = DEBUG, exempt_segments: tuple[str, ...] = ("test", "tests", "cli", "main", "bin", "scripts")) -> Result:
    """A debugging call outside tests and command-line entry points."""
    exempt = F.arrays_overlap(F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "[/_.-]"), F.array(*map(F.lit, exempt_segments)))
    return _calls(modules, F.col("callee").isin(*artifacts) & ~exempt, text("`", F.col("callee"), "` was left behind"))


@rule("ALL-FUNC0011", "ModuleFact")
def reflective_scope_read(modules: FactTable, reflections: tuple[str, ...] = REFLECTIVE) -> Result:
    """Calls that read a scope by reflection."""
    return _calls(modules, F.col("callee").isin(*reflections), text("`", F.col("callee"), "` reads a scope"))


@rule("ALL-SECU0002", "ModuleFact")
def weak_hashing_primitive(modules: FactTable, also_broken: tuple[str, ...] = (), factories: tuple[str, ...] = ("hashlib.new",)) -> Result:
    """A broken digest, by its name or a factory's literal argument."""
    return _calls(modules, _named(*WEAK_HASHES, *also_broken) | (F.col("callee").isin(*factories) & F.coalesce(F.col("first").rlike(WEAK_NAMES), F.lit(False))), text("`", F.col("callee"), "` is broken"))


@rule("ALL-SECU0005", "ModuleFact")
def command_built_from_a_shell_string(modules: FactTable, also_through_a_shell: tuple[str, ...] = ()) -> Result:
    """A process started through a shell."""
    return _calls(modules, _named(*SHELLS, *also_through_a_shell) | (F.col("callee").startswith("subprocess.") & F.array_contains("keywords", "shell")), text("`", F.col("callee"), "` goes through a shell"))


@rule("PY-ASYN0001", "ModuleFact", language="python")
def asyncio_run_boundary(modules: FactTable) -> Result:
    """asyncio.run calls."""
    return _calls(modules, _named("asyncio.run"), text("an event loop starts here"))


@rule("PY-ASYN0002", "FunctionFact", "ModuleFact", output="boolean", language="python")
def task_group_candidate(functions: FactTable, modules: FactTable) -> Result:
    """A function that creates tasks and gathers them."""
    from .shape import flag

    by = modules.relation("call").where(F.col("callee").rlike(r"(?:^|\.)(?:create_task|gather)$")).groupBy("path", F.col("in_function").alias("name")).agg(F.count_distinct(F.substring_index("callee", ".", -1)).alias("_kinds"))
    table = FactTable("FunctionFact", {"facts": functions.facts().join(by, ["path", "name"], "left")})
    return flag(table, F.col("is_async") & (F.col("_kinds") == 2), text("`", F.col("qualname"), "` gathers tasks it creates"))


@rule("PY-ASYN0003", "ModuleFact", language="python")
def deprecated_event_loop_policy(modules: FactTable) -> Result:
    """Calls that set or read an event loop policy."""
    return _calls(modules, F.col("callee").rlike(r"(?:^|\.)(?:set_event_loop_policy|get_event_loop_policy)$"), text("`", F.col("callee"), "` is deprecated"))


@rule("PY-ASYN0004", "ModuleFact", language="python")
def default_executor_to_thread_candidate(modules: FactTable) -> Result:
    """run_in_executor with the default executor."""
    return _calls(modules, F.col("callee").endswith("run_in_executor") & (F.col("first") == "None"), text("to_thread would do"))


@rule("PY-ASYN0005", "ModuleFact", language="python")
def deprecated_coroutine_check(modules: FactTable) -> Result:
    """asyncio.iscoroutinefunction."""
    return _calls(modules, _named("asyncio.iscoroutinefunction"), text("inspect has this check"))


@rule("PY-CLAS0008", "ModuleFact", language="python")
def direct_method_descriptor_call(modules: FactTable) -> Result:
    """staticmethod or classmethod called as a function."""
    return _calls(modules, _named("staticmethod", "classmethod"), text("`", F.col("callee"), "` is a decorator"))


@rule("PY-CLAS0010", "ModuleFact", language="python")
def dynamic_super_receiver(modules: FactTable) -> Result:
    """super(type(self), ...)."""
    return _calls(modules, (F.col("callee") == "super") & F.coalesce(F.col("first").rlike(r"^(?:type\(|self\.__class__)"), F.lit(False)), text("super depends on the instance's class"))


@rule("PY-CLI0001", "ModuleFact", language="python")
def argparse_construction(modules: FactTable) -> Result:
    """argparse parsers."""
    return _calls(modules, _named("argparse.ArgumentParser", "ArgumentParser"), text("a parser is built by hand"))


@rule("PY-COLL0004", "ModuleFact", language="python")
def explicit_tuple_construction(modules: FactTable) -> Result:
    """tuple() and frozenset() calls."""
    return _calls(modules, _named("tuple", "frozenset"), text("`", F.col("callee"), "` copies"))


@rule("PY-LOGG0001", "ModuleFact", language="python")
def logger_boundary_bypass(modules: FactTable, direct_logger_symbols: tuple[str, ...] = ("logging.getLogger", "logging.basicConfig", "logging.info", "logging.warning", "logging.error", "logging.debug")) -> Result:
    """Direct use of the standard logger."""
    return _calls(modules, F.col("callee").isin(*direct_logger_symbols), text("`", F.col("callee"), "` bypasses the logger"))


@rule("PY-PYDA0004", "ModuleFact", language="python")
def redundant_model_validate(modules: FactTable) -> Result:
    """model_validate on a literal."""
    return _calls(modules, F.col("callee").endswith(".model_validate") & F.col("first_is_literal"), text("the constructor would do"))


@rule("PY-SQLA0002", "ModuleFact", language="python")
def session_commit_inside_loop(modules: FactTable) -> Result:
    """A commit inside a loop."""
    return _calls(modules, F.col("callee").endswith(".commit") & F.col("in_loop"), text("`", F.col("callee"), "` commits in a loop"))


@rule("PY-SQLA0001", "ModuleFact", language="python")
def async_session_expiration(modules: FactTable) -> Result:
    """An async session factory without expire_on_commit."""
    return _calls(modules, F.col("callee").endswith("async_sessionmaker") & ~F.array_contains("keywords", "expire_on_commit"), text("objects expire on commit"))


@rule("PY-TEST0009", "ModuleFact", language="python")
def synchronous_test_asyncio_run(modules: FactTable) -> Result:
    """asyncio.run in a synchronous test."""
    return _calls(modules, _named("asyncio.run") & F.coalesce(F.col("in_function").startswith("test_"), F.lit(False)) & ~F.col("in_async"), text("a test starts its own loop"))


@rule("PY-TYPE0008", "ModuleFact", language="python")
def redundant_boolean_conversion(modules: FactTable) -> Result:
    """bool() around a comparison or negation."""
    return _calls(modules, (F.col("callee") == "bool") & F.coalesce(F.col("first").rlike(r"^not |[<>=!]=|\b(?:is|in)\b|^(?:True|False|isinstance\()"), F.lit(False)), text("the value is a Boolean already"))


@rule("PY-TYPE0005", "ModuleFact", language="python")
def repeated_cast_patterns(modules: FactTable, minimum_repetitions: int = 3) -> Result:
    """The same cast several times."""
    rows = modules.relation("call").where(_named("cast", "typing.cast"))
    many = rows.groupBy("fact_id", "first").agg(F.count("*").alias("n")).where(F.col("n") >= minimum_repetitions)
    return counted(modules, rows.join(many, ["fact_id", "first"]), text("`", F.col("first"), "` is cast ", F.col("n"), " times"))


@rule("ALL-DEPE0003", "ModuleFact")
def repeated_external_transformation(modules: FactTable, minimum_repetitions: int = 3, minimum_files: int = 2, ignored_callables: tuple[str, ...] = ()) -> Result:
    """The same one-argument call of an imported module several times in several files."""
    outside = modules.relation("import").where("level = 0 AND NOT is_from").select("fact_id", F.coalesce("alias", "module").alias("root")).distinct()
    rows = modules.relation("call").where("arguments = 1").withColumn("root", F.substring_index("callee", ".", 1)).join(outside, ["fact_id", "root"], "left_semi")
    rows = rows.where(~F.col("callee").isin(*ignored_callables)) if ignored_callables else rows
    many = rows.groupBy("callee").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")).where((F.col("n") >= minimum_repetitions) & (F.col("files") >= minimum_files))
    return counted(modules, rows.join(many, "callee"), text("`", F.col("callee"), "` is repeated in ", F.col("files"), " files"))
