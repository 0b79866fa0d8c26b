"""Rules over modules and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.facts import FactTable
from ..plans import shaping
from ..plans.contracts import Numeric, Result
from ..plans.engine import rule
from .shape import counted, counted_where, flag, measured, text

@rule("ALL-MODU0001", "ModuleFact", policy=Numeric(maximum=500))
def module_line_count(modules: FactTable) -> Result:
    """Physical lines of a module."""
    return measured(modules, F.col("line_count"), text(F.col("path"), " has ", F.col("line_count"), " lines"))


@rule("ALL-MODU0002", "ModuleFact", policy=Numeric(maximum=12))
def module_member_count(modules: FactTable) -> Result:
    """Top-level functions and classes."""
    n = F.col("functions") + F.col("classes")
    return measured(modules, n, text(F.col("path"), " declares ", n, " members"))


@rule("ALL-MODU0003", "ModuleFact", output="boolean")
def module_inception(modules: FactTable) -> Result:
    """A file named as its directory."""
    stem, parent = F.regexp_extract("path", r"([^/]+?)(?:\.[^/.]+)?$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return flag(modules, (parent != "") & (stem == parent), text(F.col("path"), " repeats its directory's name"))


@rule("ALL-MODU0004", "ModuleFact")
def non_ascii_source_path(modules: FactTable) -> Result:
    """Path components with other than ASCII characters."""
    parts = modules.facts().select("fact_id", "path", "start_line", "start_column", "end_line", "end_column", F.posexplode(F.split("path", "/")).alias("ordinal", "part")).where(F.col("part").rlike(r"[^\x00-\x7F]"))
    return counted(modules, parts, text("`", F.col("part"), "` is not plain ASCII"))


@rule("ALL-MODU0005", "ModuleFact", policy=Numeric(maximum=1))
def module_class_count(modules: FactTable) -> Result:
    """Top-level classes."""
    return measured(modules, F.col("classes"), text(F.col("path"), " holds ", F.col("classes"), " classes"))


@rule("ALL-MODU0006", "ModuleFact", policy=Numeric(maximum=200))
def module_statement_count(modules: FactTable) -> Result:
    """Statements of a module."""
    return measured(modules, F.col("statements"), text(F.col("path"), " has ", F.col("statements"), " statements"))


@rule("ALL-TEST0003", "ModuleFact", policy=Numeric(maximum=20))
def test_module_member_count(modules: FactTable) -> Result:
    """Declarations in a test module; other modules are unassessed."""
    n = F.when(F.col("is_test"), F.col("functions") + F.col("classes"))
    return measured(modules, n, text(F.col("path"), " declares ", n, " tests and helpers"))


@rule("PY-MODU0001", "ModuleFact", output="boolean", language="python")
def non_init_reexport_module(modules: FactTable) -> Result:
    """A module of only imports and __all__ that is no initializer."""
    return flag(modules, F.col("only_reexports") & ~F.col("is_init"), text(F.col("path"), " only re-exports"))


@rule("PY-MODU0002", "ModuleFact", output="boolean", language="python")
def empty_package_initializer(modules: FactTable) -> Result:
    """An initializer without a statement."""
    return flag(modules, F.col("is_init") & (F.col("statements") == 0), text(F.col("path"), " is empty"))


@rule("PY-MODU0003", "ModuleFact", language="python")
def initializer_declaration(modules: FactTable) -> Result:
    """Declarations inside an initializer."""
    n = F.when(F.col("is_init"), F.col("functions") + F.col("classes")).otherwise(0)
    return measured(modules, n, text(F.col("path"), " declares ", n, " members"))


@rule("PY-MODU0004", "ModuleFact", output="boolean", language="python")
def explicit_all_only_in_initializer(modules: FactTable) -> Result:
    """__all__ outside an initializer."""
    return flag(modules, F.col("has_all") & ~F.col("is_init"), text(F.col("path"), " states __all__"))


@rule("PY-CONS0003", "ModuleFact", language="python")
def constant_order(modules: FactTable) -> Result:
    """Constants after the first function or class."""
    return measured(modules, F.col("out_of_place_constants"), text(F.col("out_of_place_constants"), " constants stand apart"))


@rule("PY-CONS0001", "ModuleFact", language="python")
def public_module_constant(modules: FactTable) -> Result:
    """Public module constants."""
    return counted_where(modules, "binding", F.col("is_constant") & ~F.col("name").startswith("_"), text("`", F.col("name"), "` is a public constant"))


@rule("PY-CONS0002", "ModuleFact", language="python")
def cross_module_constant_import(modules: FactTable) -> Result:
    """Constants imported from another module of the project (a relative import)."""
    return counted_where(modules, "import", F.col("is_from") & (F.col("level") > 0) & F.col("name").rlike(r"^[A-Z][A-Z0-9_]+$"), text("`", F.col("name"), "` is a constant of another module"))


@rule("PY-IMPO0002", "ModuleFact", language="python")
def project_private_import(modules: FactTable) -> Result:
    """Import of a private module or member."""
    private = F.exists(F.split(F.coalesce("module", F.lit("")), r"\."), lambda x: x.rlike("^_[^_]")) | F.coalesce(F.col("name").rlike("^_[^_]"), F.lit(False))
    return counted_where(modules, "import", private, text("`", F.col("module"), "` is private"))


@rule("PY-IMPO0003", "ModuleFact", language="python", safety="review")
def unused_import(modules: FactTable) -> Result:
    """A binding nothing reads; the repair removes it."""
    used = F.col("is_used")
    rows = modules.relation("import").join(modules.facts().where("is_init").select("fact_id"), "fact_id", "left_anti").where(~used)
    out = counted(modules, rows, text("`", F.coalesce("alias", "name", "module"), "` is never used"))
    rewrites = rows.select("fact_id", F.col("ordinal").alias("rewrite_order"), F.lit("remove").alias("kind"), F.lit("").alias("source"), F.coalesce("alias", "name", "module").alias("name"), F.lit(False).alias("references_complete"))
    nodes = rows.select("fact_id", F.col("ordinal").alias("rewrite_order"), F.lit("target").alias("role"), F.lit(0).alias("ordinal"), "path", F.col("line").alias("start_line"), F.lit("import").alias("kind"))
    out.fix = shaping.fix(rewrites, nodes, summary="remove the binding")
    return out


@rule("PY-IMPO0004", "ModuleFact", language="python")
def relative_import_beyond_package(modules: FactTable) -> Result:
    """A relative import with more dots than its file has directories."""
    return counted_where(modules, "import", F.col("level") > F.size(F.split("path", "/")) - 1, text("the import leaves its package"))


@rule("PY-IMPO0005", "ModuleFact", policy=Numeric(maximum=3), language="python")
def import_module_depth(modules: FactTable) -> Result:
    """Deepest dotted import, measured once per statement."""
    rows = modules.relation("import").where("module IS NOT NULL").withColumn("depth", F.size(F.split("module", r"\.")).cast("long"))
    from .shape import highest

    return highest(modules, rows, "depth", text("`", F.col("module"), "` is ", F.col("depth"), " deep"))


@rule("PY-TEST0001", "ModuleFact", language="python")
def conftest_import(modules: FactTable, allowed_modules: tuple[str, ...] = ()) -> Result:
    """Import of a conftest module."""
    rows = modules.relation("import").where(F.concat_ws(".", "module", "name").rlike(r"(?:^|\.)conftest(?:\.|$)"))
    return counted(modules, rows.where(~F.col("module").isin(*allowed_modules)) if allowed_modules else rows, text("conftest is imported"))


@rule("PY-TYPE0001", "ModuleFact", language="python")
def future_annotations_import(modules: FactTable) -> Result:
    """`from __future__ import annotations`."""
    return counted_where(modules, "import", F.expr("module = '__future__' AND name = 'annotations'"), text("annotations are imported from the future"))


@rule("PY-TYPE0002", "ModuleFact", language="python")
def nullable_boolean_annotation(modules: FactTable) -> Result:
    """A Boolean that may be None."""
    return counted_where(modules, "annotation", F.expr("nullable_boolean"), text("`", F.col("text"), "` has three values"))


@rule("PY-TYPE0004", "ModuleFact", language="python")
def prohibited_annotation(modules: FactTable, prohibited: tuple[str, ...] = ("Any", "object")) -> Result:
    """Forbidden names in annotations."""
    hit = F.exists("names", lambda x: F.substring_index(x, ".", -1).isin(*prohibited))
    return counted_where(modules, "annotation", hit, text("`", F.col("text"), "` says nothing"))


@rule("PY-TYPE0007", "ModuleFact", language="python")
def repeated_annotated_constraint(modules: FactTable, minimum_repetitions: int = 3, minimum_files: int = 2) -> Result:
    """The same Annotated recipe several times in several files."""
    rows = modules.relation("annotation").where(F.col("text").startswith("Annotated["))
    many = rows.groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")).where((F.col("n") >= minimum_repetitions) & (F.col("files") >= minimum_files))
    return counted(modules, rows.join(many, "text"), text("`", F.col("text"), "` is repeated"), (("repetitions", F.col("n"), "count"),))
