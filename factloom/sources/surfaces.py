"""Lexical facts of Rust, TypeScript and CUDA files: one row per file, counted in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.facts import FactTable, latest

_STRIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*+\"|`(?:[^`\\]|\\.)*+`", re.S)
_RUST_DECLARED = re.compile(r"\b(?:fn|struct|enum|trait|impl|type)\b[^;{(]*<\s*'\w+")
_RUST_STATIC = re.compile(r"&\s*'static\b")
_RUST_ELIDABLE = re.compile(r"\bfn\s+\w+\s*<\s*('\w+)\s*>\s*\(([^)]*)\)(?:\s*->\s*([^{;]*))?")
_RUST_CLONE = re.compile(r"\.(?:clone|to_owned)\(\)")
_RUST_STEP = re.compile(r"\b(?:for|while|loop)\b|[{}]|\.(?:clone|to_owned)\(\)")
_TS_STAR = re.compile(r"^\s*export\s+\*", re.M)
_TS_IMPORT = re.compile(r"(?:\bfrom|\bimport)\s*\(?\s*[\"']((?:\.\.?/)+)")
_TS_KEPT = re.compile(r"\b(?:const\s+)?enum\s+\w+|\bnamespace\s+[\w.]+\s*\{|\bimport\s+\w+\s*=|constructor\s*\([^)]*\b(?:public|private|protected|readonly)\b")
_TS_ESCAPE = re.compile(r":\s*any\b|\bas\s+any\b|\bas\s+unknown\s+as\b|<any>|@ts-(?:ignore|nocheck|expect-error)")


def rust(text: str) -> dict[str, int]:
    code = _STRIP.sub(lambda m: " " * 0 + "\n" * m[0].count("\n"), text)
    elidable = 0
    for life, given, back in _RUST_ELIDABLE.findall(code):
        elidable += len(re.findall(rf"&\s*{life}\b", given)) == 1 and given.count("&") == 1 and given.count(life) == 1 and (back or "").count("'") == (back or "").count(life)
    depth, loops, pending, inside = 0, [], False, 0
    for step in _RUST_STEP.findall(code):
        if step == "{":
            depth += 1
            if pending:
                loops.append(depth)
                pending = False
        elif step == "}":
            if loops and loops[-1] == depth:
                loops.pop()
            depth -= 1
        elif step[0] == ".":
            inside += bool(loops)
        else:
            pending = True
    return {"lifetimes": len(_RUST_DECLARED.findall(code)), "static_references": len(_RUST_STATIC.findall(code)), "elidable": elidable, "clones": len(_RUST_CLONE.findall(code)), "loop_clones": inside}


def typescript(text: str) -> dict[str, int]:
    code = re.sub(r"/\*.*?\*/", lambda m: m[0] if "@ts-" in m[0] else "\n" * m[0].count("\n"), text, flags=re.S)
    return {"stars": len(_TS_STAR.findall(code)), "import_depth": max((x.count("../") for x in _TS_IMPORT.findall(code)), default=0), "kept": len(_TS_KEPT.findall(code)), "escapes": sum(bool(_TS_ESCAPE.search(x)) for x in code.split("\n")), "lines": len(code.split("\n"))}


_CUDA_BARRIER = re.compile(r"\b(?:__syncthreads|__syncwarp|__shfl(?:_up|_down|_xor)?_sync|__(?:any|all|ballot)_sync)\s*\(")
_CUDA_LAUNCH = re.compile(r"\b\w+\s*(?:<[^<>;]*>)?\s*<<<(.*?)>>>", re.S)
_CUDA_COPY = re.compile(r"\bcudaMemcpy(?:2D|3D|ToSymbol|FromSymbol)?\s*\(")
_CUDA_STREAM = re.compile(r"\bcudaStream(?:_t|Create\w*)\b")


def device(text: str) -> dict[str, int]:
    """Of a CUDA text: barriers and warp calls, kernel launches without a stream, synchronous copies; the last two where it uses streams."""
    code = _STRIP.sub(lambda m: "\n" * m[0].count("\n"), text)
    streams = bool(_CUDA_STREAM.search(code))
    return {"barriers": len(_CUDA_BARRIER.findall(code)), "default_launches": streams * sum(_parts(x) < 4 for x in _CUDA_LAUNCH.findall(code)), "copies": streams * len(_CUDA_COPY.findall(code))}


def _parts(text: str) -> int:
    """Arguments on the outermost level of a list."""
    depth, n = 0, 1
    for sign in text:
        depth += (sign in "([{") - (sign in ")]}")
        n += sign == "," and depth == 0
    return n


def _table(files: DataFrame, suffix: str, language: str, read, family: str) -> FactTable:
    columns = list(read(""))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(f, r, p, *read(t).values()) for f, r, p, t in zip(batch["file_id"], batch["repository"], batch["path"], batch["text"])], columns=["file_id", "repository", "path", *columns])

    repository = F.col("repository") if "repository" in files.columns else F.lit(None).cast("string").alias("repository")
    rows_ = latest(files.where(F.col("path").rlike(suffix) & F.col("text").isNotNull()).select("file_id", repository, "path", "text", "ingested_at"), "file_id", F.col("ingested_at").desc_nulls_last(), "text").drop("ingested_at")
    rows = rows_.mapInPandas(extract, "file_id long, repository string, path string, " + ", ".join(f"{c} long" for c in columns))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return FactTable(family, {"facts": rows.select(F.col("file_id").alias("fact_order"), F.concat_ws(":", F.lit("file"), "repository", "path").alias("fact_id"), "path", one.alias("start_line"), none.alias("start_column"), one.alias("end_line"), none.alias("end_column"), F.lit(language).alias("language"), *columns)})


def tables(files: DataFrame) -> dict[str, FactTable]:
    return {"RustSurfaceFact": _table(files, r"[.]rs$", "rust", rust, "RustSurfaceFact"), "ModuleSurfaceFact": _table(files, r"[.]ts$", "typescript", typescript, "ModuleSurfaceFact"), "DeviceSurfaceFact": _table(files, r"[.](?:cu|cuh|cpp|hpp|h)$", "cuda", device, "DeviceSurfaceFact")}
