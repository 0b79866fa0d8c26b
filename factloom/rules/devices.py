"""Rules over calls into device libraries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..operators.facts import FactTable
from ..plans.contracts import Result
from ..plans.engine import rule
from .shape import counted, counted_where, text

# Callables of device libraries.
STREAMS = r"(?:^|\.)(?:Stream|stream|create_stream|ExternalStream)$"
DEVICE_WIDE = r"(?:^|\.)(?:synchronize|deviceSynchronize|cudaDeviceSynchronize|cuCtxSynchronize)$"
RAW_MEMORY = r"(?:^|\.)(?:cudaMalloc|cudaMemcpy|cudaFree|cuMemAlloc|cuMemcpy\w*|cuMemFree|mem_alloc|memcpy_htod|memcpy_dtoh)$"
TRANSFERS = r"(?:^|\.)(?:to_device|copy_to_host|copy_to_device)$"


def _found(modules: FactTable, condition: Column, message: Column, with_streams: bool = False) -> Result:
    if not with_streams:
        return counted_where(modules, "call", condition, message)
    rows = modules.relation("call").where(condition)
    rows = rows.join(modules.relation("call").where(F.col("callee").rlike(STREAMS)).select("fact_id").distinct(), "fact_id", "left_semi")
    return counted(modules, rows, message)


@rule("PY-CUDA0001", "ModuleFact", language="python")
def direct_device_construction(modules: FactTable) -> Result:
    """Streams and contexts built by their classes instead of the device."""
    return _found(modules, F.col("callee").rlike(r"(?:^|\.)(?:core|experimental)\.(?:Stream|Context)$"), text("`", F.col("callee"), "` is built directly"))


@rule("PY-CUDA0002", "ModuleFact", language="python")
def legacy_default_stream_launch(modules: FactTable) -> Result:
    """Launches on the legacy default stream."""
    return _found(modules, F.col("callee").rlike(r"(?:^|\.)launch$") & F.coalesce(F.col("first").contains("LEGACY_DEFAULT_STREAM"), F.lit(False)), text("a kernel runs on the legacy default stream"))


@rule("PY-CUDA0003", "ModuleFact", language="python")
def device_wide_synchronization(modules: FactTable) -> Result:
    """Synchronization of the whole device where streams exist."""
    return _found(modules, F.col("callee").rlike(DEVICE_WIDE) & ~F.col("callee").rlike(r"(?i)stream\.synchronize$"), text("`", F.col("callee"), "` waits for every stream"), True)


@rule("PY-CUDA0004", "ModuleFact", language="python")
def blocking_raw_memory_operation(modules: FactTable) -> Result:
    """Synchronous raw memory operations where streams exist."""
    return _found(modules, F.col("callee").rlike(RAW_MEMORY), text("`", F.col("callee"), "` blocks"), True)


@rule("PY-NUMB0004", "ModuleFact", language="python")
def dynamic_kernel_array_shape(modules: FactTable) -> Result:
    """Kernel-local arrays whose shape is no literal."""
    return _found(modules, F.col("callee").rlike(r"(?:^|\.)(?:local|shared)\.array$") & ~F.coalesce(F.col("first").rlike(r"^[\d(),\s]+$"), F.lit(False)), text("the shape is only known at run time"))


@rule("PY-NUMB0005", "ModuleFact", language="python")
def synchronous_transfer_in_stream_scope(modules: FactTable) -> Result:
    """Transfers without a stream where streams exist."""
    return _found(modules, F.col("callee").rlike(TRANSFERS) & ~F.array_contains("keywords", "stream"), text("`", F.col("callee"), "` names no stream"), True)


@rule("PY-NUMB0007", "ModuleFact", language="python")
def device_wide_kernel_synchronization(modules: FactTable) -> Result:
    """cuda.synchronize where streams exist."""
    return _found(modules, F.col("callee") == "cuda.synchronize", text("the whole device is waited for"), True)


@rule("PY-PERF0001", "ModuleFact", language="python")
def tensor_round_trip(modules: FactTable) -> Result:
    """Tensors bridged through a copy on the host."""
    return _found(modules, F.col("callee").rlike(r"\.(?:cpu|detach)\(\)\.(?:numpy|tolist)$") | (F.col("callee").rlike(r"(?:^|\.)from_numpy$") & F.coalesce(F.col("first").rlike(r"\.get\(\)$|asnumpy\("), F.lit(False))), text("`", F.col("callee"), "` copies through the host"))


@rule("PY-TORC0001", "ModuleFact", language="python")
def fluent_tensor_call_chain(modules: FactTable, minimum_operations: int = 2) -> Result:
    """Nested tensor functions that methods could chain."""
    nested = F.size(F.regexp_extract_all(F.coalesce("first", F.lit("")), F.lit(r"\btorch\.\w+\("), F.lit(0))) >= minimum_operations - 1
    return _found(modules, F.col("callee").rlike(r"^torch\.\w+$") & nested, text("`", F.col("callee"), "` nests tensor functions"))
