"""Artifacts one language declares and others name: binaries, console scripts, native modules and kernels.

Declarations are read from manifests and sources file by file; the names are then looked for among the words of all
files' texts by one join on the word, so a repository's files are never compared with each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Languages by suffix.
LANGUAGES = {"py": "python", "rs": "rust", "ts": "typescript", "js": "javascript", "cpp": "cpp", "cu": "cuda", "toml": "toml", "json": "json", "yml": "yaml", "yaml": "yaml", "sh": "shell"}
_SECTION = re.compile(r"^\s*\[+\s*([\w.\-]+)\s*\]+\s*$")
_ENTRY = re.compile(r"^\s*\"?([\w\-]+)\"?\s*=\s*(.+?)\s*$")
_KERNEL = re.compile(r"__global__\s+(?:__\w+__\s*(?:\([^)]*\)\s*)?)*[\w:<>]+\s+(\w+)\s*\(")
_MODULE = re.compile(r"#\s*\[\s*pymodule\b[^\]]*\]\s*(?:pub\s+)?fn\s+(\w+)|\bPYBIND11_MODULE\s*\(\s*(\w+)|\bNB_MODULE\s*\(\s*(\w+)")


def language(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1]) if "." in path else None


def declared(path: str, text: str) -> list[tuple[str, str, str, int]]:
    """(name, mechanism, declaring language, line) of the artifacts one file declares."""
    found, file = [], path.rsplit("/", 1)[-1]
    if file in ("Cargo.toml", "pyproject.toml"):
        section = ""
        for number, line in enumerate(text.split("\n"), 1):
            if m := _SECTION.match(line):
                section = m[1]
            elif m := _ENTRY.match(line):
                value = m[2].strip("\"'")
                if section == "bin" and m[1] == "name":
                    found.append((value, "binary", "rust", number))
                elif section == "lib" and m[1] == "name":
                    found.append((value, "shared-library", "rust", number))
                elif section in ("project.scripts", "tool.poetry.scripts"):
                    found.append((m[1], "console-script", "python", number))
        return found
    own = language(path)
    for mechanism, pattern in (("kernel", _KERNEL), ("native-module", _MODULE)):
        for m in pattern.finditer(text):
            found.append((next(g for g in m.groups() if g), mechanism, own or "", text.count("\n", 0, m.start()) + 1))
    return found


def artifacts(files: DataFrame) -> DataFrame:
    """fact_id, path, name, mechanism, declared_language, references (for each language the least path that names it, with its language, line and the number of files)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, p, *a) for r, p, t in zip(batch["repository"], batch["path"], batch["text"]) for a in declared(p, t)]
            yield pd.DataFrame(rows, columns=["repository", "path", "name", "mechanism", "declared_language", "line"])

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r, p, t in zip(batch["repository"], batch["path"], batch["text"]):
                if own := language(p):
                    first: dict[str, int] = {}
                    for number, line in enumerate(t.split("\n"), 1):
                        for w in re.findall(r"[A-Za-z_][\w\-]*", line):
                            first.setdefault(w, number)
                    rows += [(r, w, p, own, n) for w, n in first.items()]
            yield pd.DataFrame(rows, columns=["repository", "name", "path", "language", "line"])

    kept = files.where("text IS NOT NULL AND path IS NOT NULL").select("repository", "path", "text")
    made = kept.mapInPandas(read, "repository string, path string, name string, mechanism string, declared_language string, line long").dropDuplicates(["repository", "name", "path"])
    named = made.select("repository", "name").distinct()
    said = kept.mapInPandas(words, "repository string, name string, path string, language string, line long").join(named, ["repository", "name"], "left_semi").distinct()
    joined = made.join(said.select("repository", "name", F.struct("path", "language", "line").alias("reference")), ["repository", "name"], "left").where("reference IS NULL OR reference.path <> path OR reference.language <> declared_language")
    key = ["repository", "path", "name", "mechanism", "declared_language"]
    # One reference for each language, so that a name a third of all files hold makes no long list.
    first = joined.where(F.col("reference.path") != F.col("path")).groupBy(*key, F.col("reference.language").alias("language")).agg(F.min(F.struct("reference.path", "reference.line")).alias("at"), F.count("*").alias("files"))
    found = first.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at.path", "language", "at.line", "files"))).alias("references"))
    # An artifact only its own file names has lost its row above.
    found = made.select(*key).distinct().join(found, key, "left").withColumn("references", F.coalesce("references", F.array().cast("array<struct<path:string,language:string,line:bigint,files:bigint>>")))
    return found.select(F.concat_ws(":", F.lit("artifact"), "repository", "path", "name").alias("fact_id"), "path", "name", "mechanism", "declared_language", "references")
