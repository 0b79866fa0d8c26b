"""Rules over shapes of Python code (see `sources.python_shapes`)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..operators.facts import FactTable
from ..plans.contracts import Result
from ..plans.engine import rule
from .shape import counted, counted_where, text

# Built-in types a check of which a protocol or a plain attempt replaces, and names of approved foundations.
BUILT_IN = ("dict", "list", "set", "tuple", "str", "int", "float")
FOUNDATIONS = ("BaseModel", "FrozenModel", "FlexModel", "FrozenFlexModel")


def _message(form: str) -> Column:
    """A message with the columns named in braces."""
    return text(*(F.col(part[1:-1]) if part.startswith("{") else part for part in re.split(r"(\{\w+\})", form) if part))


def _declare(id: str, name: str, about: str, relation: str, condition: str, message: str) -> None:
    """A rule that counts the rows of one relation that meet an SQL condition."""

    def build(modules: FactTable):
        return counted_where(modules, relation, F.expr(condition), _message(message))

    build.__name__, build.__doc__ = name, about
    rule(id, "ModuleFact", language="python")(build)


_declare("PY-CLAS0004", "staticmethod_calling_classmethod_count", "Static methods that call a class method of their class by its name.", "static_call", "true", "`{method}` calls `{called}` through the class")
_declare("PY-COLL0002", "literal_pair_sequence_mapping_candidate", "Sequences of pairs with literal keys.", "lookup", "pairs > 1", "`{name}` could be a mapping")
_declare("PY-COMP0002", "manual_set_comprehension", "Sets a loop fills right after they were made.", "set_loop", "true", "`{name}` could be a comprehension")
_declare("PY-DOCU0002", "tensor_docstring_semantics", "Documented functions over tensors whose text names no shape or no type.", "tensor_doc", "NOT (shape AND dtype)", "`{name}` does not say shape and dtype")
_declare("PY-ENUM0005", "prefer_enum_conversion", "`.value` of a member that is a text or number itself.", "value_read", "true", "`{owner}.{member}` needs no .value")
_declare("PY-INTE0001", "concrete_isinstance_capability", "Checks for a built-in type.", "type_check", f"exists(types, t -> t IN {BUILT_IN})", "a concrete type is checked")
_declare("PY-NUMB0001", "kernel_return_value", "Kernels that return a value.", "kernel", "returns_value", "`{name}` returns a value")
_declare("PY-NUMB0002", "conditional_block_barrier", "Kernels with a barrier only some threads may reach.", "kernel", "barriers_in_branches > 0", "`{name}` waits in a branch")
_declare("PY-NUMB0003", "unguarded_grid_index", "Kernels that never compare a grid index with a bound.", "kernel", "size(unguarded_indexes) > 0", "`{name}` does not guard its index")
_declare("PY-NUMB0006", "default_stream_numba_kernel_launch", "Kernel launches without a stream.", "launch", "parts < 3", "`{kernel}` runs in the default stream")
_declare("PY-PYDA0001", "single_field_model_validator", "Model validators that read one field.", "validator", "kind = 'model_validator_after' AND size(reads) = 1", "`{name}` could be a field validator")
_declare("PY-PYDA0002", "declarative_field_constraint_candidate", "Field validators that only compare with constants.", "validator", "kind LIKE 'field_validator%' AND declarative", "`{name}` could be a constraint")
_declare("PY-PYDA0007", "variadic_tuple_model_field", "Fields of one element type in a tuple of any length.", "model", "size(variadic_tuples) > 0", "`{name}` holds a variadic tuple")
_declare("PY-PYDA0008", "implicit_arbitrary_type_model", "Models on the foundation that takes any type.", "model", "exists(bases, b -> substring_index(b, '.', -1) = 'FrozenFlexModel')", "`{name}` takes any type")
_declare("PY-SQLA0003", "sqlmodel_execute_scalars_api", "execute(...).scalars().", "query", "form = 'execute_scalars'", "exec would do")
_declare("PY-SQLA0004", "sqlmodel_redundant_scalars", "exec(...).scalars().", "query", "form = 'exec_scalars'", "exec gives scalars already")
_declare("PY-SQLA0005", "sqlmodel_primary_key_get", "A select by the key alone.", "query", "form = 'key_select'", "get would do")
_declare("PY-TEST0018", "module_generated_parametrization_count", "Cases the module makes itself.", "generated_cases", "true", "the cases of `{name}` are made by code")


@rule("ALL-CONF0001", "ModuleFact")
def hardcoded_path_policy_count(modules: FactTable, minimum_paths: int = 3) -> Result:
    """Collections of paths bound to a name that says what is left out."""
    return counted_where(modules, "path_policy", F.col("paths") >= minimum_paths, text("`", F.col("name"), "` is a policy in code"))


@rule("ALL-FUNC0003", "ModuleFact")
def class_owned_module_helper(modules: FactTable, minimum_lines: int = 2, ignore_names: tuple[str, ...] = ()) -> Result:
    """Private helpers of a module with one caller, which is a method."""
    named = F.col("name").isin(*ignore_names) if ignore_names else F.lit(False)
    return counted_where(modules, "helper", (F.col("lines") >= minimum_lines) & (F.size("callers") == 1) & F.col("callers")[0].contains(".") & ~named, text("`", F.col("name"), "` belongs to ", F.col("callers")[0]))


@rule("PY-COLL0003", "ModuleFact", language="python")
def local_collection_representation_candidate(modules: FactTable, sequence_preference: str = "list", prefer_membership_set: bool = True) -> Result:
    """Local sequences that are only looked into, or stand in the form that is not preferred and are never changed."""
    membership = (F.size("uses") == 1) & (F.col("uses")[0] == "membership") & (F.col("elements") > 1) if prefer_membership_set else F.lit(False)
    other = (F.col("kind") != sequence_preference) & (F.size("uses") > 0) & F.forall("uses", lambda u: u.isin("iteration", "mutation"))
    return counted_where(modules, "local_list", membership | other, text("`", F.col("name"), "` has a fitter type"))


@rule("PY-CLAS0001", "ModuleFact", language="python")
def explicit_registry_name(modules: FactTable, registry_bases: tuple[str, ...] = ()) -> Result:
    """Registered classes whose stated name is the one they would get."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    bases = modules.relation("model").where(F.exists("bases", lambda b: F.substring_index(b, ".", -1).isin(*registry_bases)) if registry_bases else F.exists("bases", lambda b: b.contains("Regist"))).select("fact_id", F.col("name").alias("owner"))
    rows = modules.relation("class_text").where((F.col("name") == "name") & (plain(F.col("text")) == plain(F.col("owner")))).join(bases, ["fact_id", "owner"], "left_semi")
    return counted(modules, rows, text("`", F.col("owner"), "` states its own name"))


@rule("PY-CLAS0002", "ModuleFact", language="python")
def coupled_nested_type_candidate(modules: FactTable, suffixes: tuple[str, ...] = ("Content", "Kind"), minimum_types: int = 2, minimum_prefix_length: int = 3) -> Result:
    """Types of a module that share a prefix and differ by their role."""
    role = F.regexp_extract("name", f"^(.*?)({'|'.join(suffixes)})$", 1)
    rows = modules.relation("model").withColumn("prefix", role).where(F.length("prefix") >= minimum_prefix_length)
    many = rows.groupBy("fact_id", "prefix").agg(F.count("*").alias("n")).where(F.col("n") >= minimum_types)
    return counted(modules, rows.join(many, ["fact_id", "prefix"]), text("`", F.col("name"), "` belongs to `", F.col("prefix"), "`"))


@rule("PY-CLAS0009", "ModuleFact", language="python")
def duplicate_component_attribute_alias_count(modules: FactTable) -> Result:
    """Attributes that repeat an attribute of a component the object holds."""
    rows = modules.relation("component_alias")
    many = rows.groupBy("fact_id", "owner", "source").agg(F.count_distinct("attribute").alias("n")).where("n > 0").drop("n")
    return counted(modules, rows.join(many, ["fact_id", "owner", "source"]), text("`", F.col("attribute"), "` repeats ", F.col("source")))


@rule("PY-ENUM0002", "ModuleFact", language="python")
def parallel_enum_metadata(modules: FactTable) -> Result:
    """Tables keyed by every member of an enumeration."""
    members = modules.relation("enum").groupBy("fact_id", F.col("name").alias("enum")).agg(F.array_sort(F.collect_set("member")).alias("all"))
    rows = modules.relation("enum_table").join(members, ["fact_id", "enum"]).where("members = all")
    return counted(modules, rows, text("a table repeats the members of `", F.col("enum"), "`"))


@rule("PY-ENUM0003", "ModuleFact", language="python")
def shared_enums_module_candidate(modules: FactTable, minimum_definitions: int = 3, minimum_imported_definitions: int = 2, minimum_cross_module_imports: int = 3, preferred_modules: tuple[str, ...] = ("enums.py", "enums")) -> Result:
    """Enumerations of one module that others import often, outside a module for them."""
    defined = modules.relation("enum").select("fact_id", "name", "line").groupBy("fact_id", "name").agg(F.min("line").alias("line"))
    imported = modules.relation("import").where("is_from").select(F.col("fact_id").alias("by"), "name")
    used = defined.join(imported, "name").where("by <> fact_id").groupBy("fact_id", "name").agg(F.count_distinct("by").alias("n"))
    many = defined.groupBy("fact_id").agg(F.count("*").alias("defined")).join(used.groupBy("fact_id").agg(F.count("*").alias("used"), F.sum("n").alias("imports")), "fact_id")
    many = many.where((F.col("defined") >= minimum_definitions) & (F.col("used") >= minimum_imported_definitions) & (F.col("imports") >= minimum_cross_module_imports)).select("fact_id")
    own = modules.facts().where(~F.element_at(F.split("path", "/"), -1).isin(*preferred_modules)).select("fact_id", "path")
    return counted(modules, defined.join(many, "fact_id").join(own, "fact_id"), text("`", F.col("name"), "` could move to a module for enumerations"))


@rule("PY-IMPO0006", "ModuleFact", language="python")
def bypassed_public_import(modules: FactTable) -> Result:
    """Imports of a name from below a package that exports it itself."""
    exported = modules.relation("export").join(modules.facts().where("is_init").select("fact_id", F.col("path").alias("init")), "fact_id").select("name", F.regexp_replace(F.regexp_replace("init", r"/__init__\.py$", ""), "/", ".").alias("package"))
    rows = modules.relation("import").where("is_from AND level = 0").join(exported, "name").where(F.col("module").startswith(F.concat("package", F.lit("."))))
    return counted(modules, rows.dropDuplicates(["fact_id", "ordinal"]), text("`", F.col("name"), "` is exported by `", F.col("package"), "`"))


@rule("PY-MODE0001", "ModuleFact", language="python")
def shared_model_file_shape(modules: FactTable, foundations: tuple[str, ...] = FOUNDATIONS) -> Result:
    """Modules of a models package that do not hold exactly one model."""
    models = modules.relation("model").where(F.exists("bases", lambda b: F.substring_index(b, ".", -1).isin(*foundations))).groupBy("fact_id").agg(F.count("*").alias("n"))
    own = modules.facts().where("path LIKE '%/models/%' AND NOT is_init").join(models, "fact_id", "left").where("coalesce(n, 0) <> 1")
    return counted(modules, own.select("fact_id", "path", F.lit(0).alias("ordinal"), "n"), text("the module holds ", F.coalesce("n", F.lit(0)), " models"))


@rule("PY-MODE0003", "ModuleFact", language="python")
def approved_model_foundation(modules: FactTable, foundations: tuple[str, ...] = FOUNDATIONS) -> Result:
    """Classes that hold data and stand on a model base other than the approved ones."""
    last = lambda b: F.substring_index(b, ".", -1)
    other = F.exists("bases", lambda b: last(b).rlike("Model$") & ~last(b).isin(*foundations))
    return counted_where(modules, "model", (F.size("fields") > 0) & other, text("`", F.col("name"), "` stands on another base"))


@rule("PY-MODE0004", "ModuleFact", language="python")
def manual_model_attribute_projection_count(modules: FactTable, minimum_attributes: int = 4) -> Result:
    """Mappings that repeat the names of attributes as keys."""
    return counted_where(modules, "projection", F.col("attributes") >= minimum_attributes, text("`", F.col("receiver"), "` is written out by hand"))


@rule("PY-NAMI0002", "ModuleFact", language="python")
def attribute_visibility(modules: FactTable) -> Result:
    """Public methods that only their class uses."""
    uses = modules.relation("reference").groupBy(F.col("name").alias("method")).agg(F.sum("n").alias("all"))
    rows = modules.relation("method_use").where("inside > 0 AND outside = 0").join(uses, "method").where("all = inside")
    return counted(modules, rows, text("`", F.col("method"), "` is used by `", F.col("owner"), "` only"))


@rule("PY-PYDA0005", "ModuleFact", language="python")
def optional_variant_discriminated_union_candidate(modules: FactTable, minimum_variants: int = 2) -> Result:
    """Validators that compare several optional fields with nothing."""
    return counted_where(modules, "validator", F.col("exclusive") >= minimum_variants, text("`", F.col("owner"), "` could be a union"))


@rule("PY-PYDA0006", "ModuleFact", language="python")
def constructor_model_candidate(modules: FactTable, minimum_parameters: int = 3, minimum_attributes: int = 3, minimum_validations: int = 1, minimum_defaults: int = 1) -> Result:
    """Plain classes whose initializer does what a model would."""
    many = (F.col("parameters") >= minimum_parameters) & (F.col("attributes") >= minimum_attributes) & (F.col("checks") >= minimum_validations) & (F.col("defaults") >= minimum_defaults)
    return counted_where(modules, "model", F.col("handwritten") & many, text("`", F.col("name"), "` could be a model"))


@rule("PY-TEST0010", "ModuleFact", language="python")
def unowned_async_test_count(modules: FactTable, discovery: str = "explicit") -> Result:
    """Asynchronous tests without a runner's mark or fixture; none where the runner takes all."""
    owned = F.col("marked") | F.arrays_overlap("fixtures", F.array(F.lit("anyio_backend"), F.lit("event_loop")))
    return counted_where(modules, "async_test", F.lit(discovery == "explicit") & ~owned, text("nothing runs `", F.col("name"), "`"))
