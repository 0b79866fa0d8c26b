"""Rules over the surfaces of Rust, TypeScript and CUDA files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.facts import FactTable
from ..plans import shaping
from ..plans.contracts import Numeric, Result
from ..plans.engine import rule
from .shape import flag, measured, text


@rule("RS-LIFE0001", "RustSurfaceFact", language="rust")
def elidable_lifetime_annotation(files: FactTable) -> Result:
    """Lifetimes that elision would infer."""
    return measured(files, F.col("elidable"), text(F.col("elidable"), " lifetimes could be elided"))


@rule("RS-LIFE0002", "RustSurfaceFact", language="rust")
def demanded_static_lifetime(files: FactTable) -> Result:
    """References that must live for ever."""
    return measured(files, F.col("static_references"), text(F.col("static_references"), " references are 'static"))


@rule("RS-LIFE0003", "RustSurfaceFact", policy=Numeric(maximum=2), language="rust")
def lifetime_annotation_count(files: FactTable) -> Result:
    """Declarations that name lifetimes."""
    return measured(files, F.col("lifetimes"), text(F.col("lifetimes"), " declarations name lifetimes"))


@rule("RS-OWNE0001", "RustSurfaceFact", policy=None, language="rust")
def clone_inside_loop(files: FactTable) -> Result:
    """Clones inside loops."""
    return measured(files, F.col("loop_clones"), text(F.col("loop_clones"), " clones in loops"))


@rule("RS-OWNE0002", "RustSurfaceFact", policy=None, language="rust")
def clone_call_count(files: FactTable) -> Result:
    """Clones."""
    return measured(files, F.col("clones"), text(F.col("clones"), " clones"))


@rule("TS-MODU0001", "ModuleSurfaceFact", language="typescript")
def star_reexport(files: FactTable) -> Result:
    """Star re-exports."""
    return measured(files, F.col("stars"), text(F.col("stars"), " star re-exports"))


@rule("TS-MODU0002", "ModuleSurfaceFact", policy=Numeric(maximum=1), language="typescript")
def relative_import_depth(files: FactTable) -> Result:
    """Deepest relative import."""
    return measured(files, F.col("import_depth"), text("an import climbs ", F.col("import_depth"), " directories"))


@rule("TS-TYPE0001", "ModuleSurfaceFact", language="typescript")
def non_erasable_construct(files: FactTable) -> Result:
    """Constructs that types alone cannot erase."""
    return measured(files, F.col("kept"), text(F.col("kept"), " constructs stay at run time"))


@rule("TS-TYPE0002", "ModuleSurfaceFact", output="float", policy=Numeric(maximum=2), language="typescript")
def escape_hatch_density(files: FactTable) -> Result:
    """Percentage of lines that escape the type checker."""
    facts = files.facts()
    share = F.when(F.col("lines") > 0, F.col("escapes") * 100.0 / F.col("lines")).otherwise(0.0)
    return shaping.floating(facts, share, shaping.findings(facts.where("escapes > 0"), text(F.col("escapes"), " lines escape the checker"), (("share", share, "percentage"),), order=F.lit(0)))


@rule("CU-LAUN0001", "DeviceSurfaceFact")
def raw_barrier_over_cooperative_groups(files: FactTable) -> Result:
    """Barriers and warp calls by name instead of a group's."""
    return measured(files, F.col("barriers"), text(F.col("barriers"), " raw barriers"))


@rule("CU-LAUN0002", "DeviceSurfaceFact", output="boolean")
def default_stream_kernel_launch(files: FactTable) -> Result:
    """Whether a file that uses streams launches a kernel in the default one."""
    return flag(files, F.col("default_launches") > 0, text(F.col("default_launches"), " launches name no stream"))


@rule("CU-MEMO0001", "DeviceSurfaceFact")
def synchronous_transfer_in_stream_scope(files: FactTable) -> Result:
    """Synchronous copies in a file that uses streams."""
    return measured(files, F.col("copies"), text(F.col("copies"), " copies wait"))
