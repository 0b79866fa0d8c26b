"""Rules over callables and their parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.facts import FactTable
from ..operators.text import adjacent_equal
from ..plans import shaping
from ..plans.contracts import Numeric, Result
from ..plans.engine import rule
from .shape import counted, flag, located, measured, text



@rule("ALL-FUNC0001", "FunctionFact", policy=Numeric(maximum=10))
def function_statement_count(functions: FactTable) -> Result:
    """Direct statements of a callable."""
    return measured(functions, F.col("statements"), text("`", F.col("qualname"), "` has ", F.col("statements"), " statements"))


@rule("ALL-FUNC0004", "FunctionFact", output="boolean")
def one_line_nested_function(functions: FactTable, minimum_references: int = 2) -> Result:
    """A one-line nested function that is used less than twice."""
    return flag(functions, F.col("is_nested") & (F.col("lines") <= 1) & (F.col("references") < minimum_references), text("`", F.col("qualname"), "` could be written where it is used"))


@rule("ALL-FUNC0005", "FunctionFact", output="boolean")
def transparent_wrapper(functions: FactTable) -> Result:
    """A function that only hands its one parameter on to one call."""
    return flag(functions, F.col("returns_call") & ~F.col("is_method"), text("`", F.col("qualname"), "` only forwards its argument"))


@rule("ALL-FUNC0006", "FunctionFact", output="boolean")
def shallow_callable(functions: FactTable, minimum_references: int = 2, minimum_operations: int = 1, ignore_names: tuple[str, ...] = ()) -> Result:
    """An undocumented one-line public function with few operations and references."""
    thin = F.col("is_public") & ~F.col("has_docstring") & (F.col("lines") <= 1) & ~F.col("is_test") & (F.col("operations") <= minimum_operations) & (F.col("references") < minimum_references)
    return flag(functions, thin & ~F.col("name").isin(*ignore_names) if ignore_names else thin, text("`", F.col("qualname"), "` hides almost nothing"))


@rule("ALL-FUNC0007", "FunctionFact", policy=Numeric(maximum=4))
def function_conditional_count(functions: FactTable) -> Result:
    """Conditionals of a callable."""
    return measured(functions, F.col("conditionals"), text("`", F.col("qualname"), "` decides ", F.col("conditionals"), " times"))


@rule("ALL-FUNC0008", "FunctionFact", policy=Numeric(maximum=8))
def cognitive_complexity(functions: FactTable, nesting_penalty: int = 1) -> Result:
    """Control structures, each with a penalty for its depth."""
    value = F.col("controls") + nesting_penalty * F.col("control_depth")
    return measured(functions, value, text("`", F.col("qualname"), "` has a complexity of ", value))


@rule("ALL-FUNC0009", "FunctionFact", policy=Numeric(maximum=2))
def nesting_depth(functions: FactTable) -> Result:
    """Greatest depth of nested control structures."""
    return measured(functions, F.col("nesting"), text("`", F.col("qualname"), "` nests ", F.col("nesting"), " deep"))


@rule("ALL-FUNC0010", "FunctionFact", policy=Numeric(maximum=5))
def required_parameter_count(functions: FactTable) -> Result:
    """Parameters a caller must give, without the receiver."""
    rows = functions.relation("parameters").where("NOT is_receiver AND NOT has_default AND kind NOT IN ('variadic', 'keywords')")
    facts = functions.counted(rows)
    return shaping.integer(facts, "count", shaping.findings(facts, text("`", F.col("qualname"), "` requires ", F.col("count"), " arguments"), (("parameters", F.col("count"), "count"),), order=F.lit(0)), F.lit(1))


@rule("ALL-FUNC0002", "FunctionFact", output="boolean")
def single_use_trivial_helper(functions: FactTable, maximum_lines: int = 1, ignore_names: tuple[str, ...] = ()) -> Result:
    """A private module function of a line that is used once."""
    helper = ~F.col("is_public") & ~F.col("is_method") & ~F.col("is_nested") & (F.col("lines") <= maximum_lines) & (F.col("references") == 1) & (F.size("decorators") == 0)
    return flag(functions, helper & ~F.col("name").isin(*ignore_names) if ignore_names else helper, text("`", F.col("qualname"), "` is used once and does one thing"))


@rule("ALL-PARA0001", "FunctionFact")
def swappable_parameter_pair(functions: FactTable) -> Result:
    """Neighbouring parameters of one type."""
    rows = functions.relation("parameters").where("NOT is_receiver AND kind <> 'keyword_only'").select("fact_id", "path", "ordinal", "name", F.coalesce("annotation", F.lit("")).alias("annotation"))
    pairs = adjacent_equal(rows, ["fact_id"], "ordinal", "annotation")
    spans = functions.facts().select("fact_id", "start_line", "start_column", "end_line", "end_column")
    return counted(functions, pairs.join(spans, "fact_id"), text("`", F.col("name"), "` and its neighbour are both `", F.col("annotation"), "`"))


@rule("ALL-PARA0002", "FunctionFact")
def configuration_object_parameter(functions: FactTable, minimum_reads: int = 2, configuration_markers: tuple[str, ...] = ("config", "configuration", "settings", "options")) -> Result:
    """A configuration parameter that is only read through its attributes."""
    named = F.lit(False)
    for m in configuration_markers:
        named = named | F.lower("name").contains(m)
    rows = functions.relation("parameters").where(named & (F.col("attribute_reads") >= minimum_reads) & (F.col("attribute_reads") == F.col("reads")))
    return counted(functions, located(rows), text("`", F.col("name"), "` is only read through attributes"))


@rule("ALL-PARA0003", "FunctionFact")
def positional_boolean_parameter(functions: FactTable) -> Result:
    """A Boolean that callers need not name."""
    return counted(functions, located(functions.relation("parameters").where("is_boolean AND kind IN ('positional', 'positional_only')")), text("`", F.col("name"), "` can be passed without its name"))


@rule("ALL-PARA0004", "FunctionFact", policy=Numeric(maximum=1))
def boolean_parameter_count(functions: FactTable) -> Result:
    """Boolean parameters."""
    return counted(functions, located(functions.relation("parameters").where("is_boolean")), text("`", F.col("name"), "` switches behaviour"))


@rule("PY-FUNC0001", "FunctionFact", language="python")
def positional_only_parameter_count(functions: FactTable, allowed_names: tuple[str, ...] = ()) -> Result:
    """Positional-only parameters beyond the allowed ones."""
    rows = functions.relation("parameters").where("kind = 'positional_only'")
    return counted(functions, located(rows.where(~F.col("name").isin(*allowed_names)) if allowed_names else rows), text("`", F.col("name"), "` cannot be named by callers"))


@rule("PY-COLL0001", "FunctionFact", output="boolean", language="python")
def concrete_collection_parameter(functions: FactTable) -> Result:
    """A parameter annotated with a concrete collection."""
    rows = functions.relation("parameters").where(F.col("annotation").rlike(r"^(?:list|dict|set|tuple)\b")).groupBy("fact_id").agg(F.min("name").alias("_name"))
    table = FactTable("FunctionFact", {"facts": functions.facts().join(rows, "fact_id", "left")})
    return flag(table, F.col("_name").isNotNull(), text("`", F.col("_name"), "` asks for a concrete collection"))


@rule("PY-CACH0001", "FunctionFact", output="boolean", language="python")
def instance_independent_cached_property(functions: FactTable) -> Result:
    """A cached property that never reads its receiver."""
    return flag(functions, F.exists("decorators", lambda x: x.endswith("cached_property")) & (F.col("receiver_reads") == 0), text("`", F.col("qualname"), "` does not depend on its instance"))


@rule("PY-CACH0002", "FunctionFact", output="boolean", language="python")
def cached_instance_method(functions: FactTable) -> Result:
    """A cache on an instance method."""
    return flag(functions, F.col("is_method") & F.exists("decorators", lambda x: x.isin("cache", "lru_cache", "functools.cache", "functools.lru_cache")) & ~F.exists("decorators", lambda x: x.isin("staticmethod", "classmethod")), text("`", F.col("qualname"), "` keeps its instances alive"))


@rule("PY-DEAD0001", "FunctionFact", output="boolean", language="python")
def unreferenced_private_function(functions: FactTable) -> Result:
    """A private module function nothing refers to."""
    return flag(functions, ~F.col("is_public") & ~F.col("is_method") & ~F.col("is_nested") & (F.col("references") == 0) & (F.size("decorators") == 0) & ~F.col("name").rlike("^__"), text("nothing refers to `", F.col("qualname"), "`"))


@rule("PY-DOCU0001", "FunctionFact", output="boolean", language="python")
def docstring_style(functions: FactTable, maximum_summary: int = 99) -> Result:
    """A docstring whose first line is too long or does not end a sentence."""
    summary = F.trim(F.split("docstring", "\n")[0])
    return flag(functions, F.col("has_docstring") & ((F.length(summary) > maximum_summary) | ~summary.rlike(r"[.!?]$")), text("the summary of `", F.col("qualname"), "` is no short sentence"))


@rule("PY-NAMI0001", "FunctionFact", output="boolean", language="python")
def boolean_predicate_name(functions: FactTable, prefixes: tuple[str, ...] = ("is_", "has_", "can_", "should_", "supports_")) -> Result:
    """A Boolean-returning property whose name asks no question."""
    asks = F.lit(False)
    for p in prefixes:
        asks = asks | F.regexp_replace("name", "^_+", "").startswith(p)
    return flag(functions, F.exists("decorators", lambda x: x == "property") & F.col("docstring").rlike(r"(?i)^\s*(?:whether|true if|return whether)") & ~asks, text("`", F.col("qualname"), "` answers a question its name does not ask"))


@rule("PY-PYDA0003", "FunctionFact", output="boolean", language="python")
def imperative_model_input_validation(functions: FactTable) -> Result:
    """A factory method with many conditionals over raw input."""
    return flag(functions, F.exists("decorators", lambda x: x == "classmethod") & F.col("name").rlike(r"^from_") & (F.col("conditionals") >= 3), text("`", F.col("qualname"), "` validates by hand"))
