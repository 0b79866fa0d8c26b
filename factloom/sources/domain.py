"""The project's flat tables as fact tables: history, comments, prose, module coupling and classes."""

from __future__ import annotations

import ast
import re
import textwrap
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import forest, history, text
from ..operators.facts import FactTable


def _identity(key: Column, path: Column, language: Column | None = None) -> list[Column]:
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # A stable number for the order of facts whose key is a text.
    return [F.abs(F.xxhash64(key)).alias("fact_order"), key.alias("fact_id"), path.alias("path"), one.alias("start_line"), none.alias("start_column"), one.alias("end_line"), none.alias("end_column"), (F.lit(None).cast("string") if language is None else language).alias("language")]


def history_table(files: DataFrame) -> FactTable:
    """One fact per repository with its files (the latest row of each)."""
    rows = history.files(files)
    facts = rows.select("repository").distinct().select(*_identity(F.concat(F.lit("history:"), "repository"), F.col("repository")))
    return FactTable("RepositoryHistoryFact", {"facts": facts, "files": rows.withColumn("fact_id", F.concat(F.lit("history:"), "repository")).withColumn("ordinal", F.col("path"))})


def comment_table(groups: DataFrame) -> FactTable:
    """One fact per file with its comment groups."""
    rows = text.comments(groups).withColumn("fact_id", F.concat_ws(":", F.lit("comments"), "repository", "path")).withColumn("ordinal", F.col("group_id"))
    return FactTable("CommentFact", {"facts": rows.select("repository", "path").distinct().select(*_identity(F.concat_ws(":", F.lit("comments"), "repository", "path"), F.col("path"))), "groups": rows})


def parsed_comment_table(groups: DataFrame) -> FactTable:
    """The comment table with parses_as_source: whether a group's text is code.

    Of Python files, text that parses and is more than names, literals or a lone word; of others, text every line of which
    ends as statements do, with its brackets in balance.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(parses_as_source=[_is_code(p, b) for p, b in zip(batch["path"], batch["body"])])

    table = comment_table(groups)
    rows = table.relation("groups").select("fact_id", "ordinal", "repository", "path", "group_id", "body", "line_count")
    flagged = rows.mapInPandas(read, "fact_id string, ordinal long, repository string, path string, group_id long, body string, line_count long, parses_as_source boolean")
    return FactTable("ParsedCommentFact", {"facts": table.relation("facts"), "groups": flagged})


_MARK = re.compile(r"^[ \t]*(?:#+|/{2,}|/?\*+/?)?[ ]?", re.M)
_STATEMENT_END = re.compile(r"[;{}]\s*$|^\s*$")


def _is_code(path: str | None, body: str) -> bool:
    text = textwrap.dedent(_MARK.sub("", body.replace("\r\n", "\n"))).strip()
    if not text:
        return False
    if (path or "").endswith(".py"):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return any(not (isinstance(s, ast.Expr) and not any(isinstance(n, ast.Call) for n in ast.walk(s.value))) for s in tree.body)
    lines = text.split("\n")
    return all(map(_STATEMENT_END.search, lines)) and all(text.count(a) == text.count(b) for a, b in ("()", "[]", "{}"))


def prose_table(documents: DataFrame) -> FactTable:
    """One fact per document, with its whole text as the one section."""
    key = F.concat(F.lit("document:"), "doc_id")
    return FactTable("ProseSegmentFact", {"facts": documents.select("doc_id").distinct().select(*_identity(key, key)), "sections": documents.select(key.alias("fact_id"), F.lit(0).alias("ordinal"), "text")})


def coupling_table(classes: DataFrame) -> FactTable:
    """One fact per repository with its module import edges (importer, module)."""
    edges = classes.select("repository", F.col("module").alias("target"), F.explode("importers").alias("source")).where("source IS NOT NULL AND target IS NOT NULL").distinct().withColumn("fact_id", F.concat(F.lit("coupling:"), "repository"))
    return FactTable("ModuleCouplingFact", {"facts": classes.select("repository").distinct().select(*_identity(F.concat(F.lit("coupling:"), "repository"), F.col("repository"))), "edges": edges})


def override_table(classes: DataFrame) -> FactTable:
    """One fact per class with the number of its ancestors (-1: its chain never ends)."""
    edges = classes.sparkSession.createDataFrame([], "child_id string, parent_id string")
    depth = forest.roots(forest.fact_links(edges, classes)).select(F.col("node").alias("class_id"), F.col("depth").alias("ancestors"))
    facts = classes.select("class_id", "module").dropDuplicates(["class_id"]).join(depth, "class_id")
    return FactTable("OverrideFact", {"facts": facts.select(*_identity(F.concat(F.lit("class:"), "class_id"), F.col("module")), "class_id", "ancestors")})


def route_table(groups: DataFrame) -> FactTable:
    """One fact per repository with the addresses its literals name; the other places of an address are its references."""
    found = text.routes(groups).withColumns({"fact_id": F.concat(F.lit("routes:"), "repository")})
    paths = found.groupBy("fact_id", "route").agg(F.min("path").alias("least"), F.max("path").alias("most"))
    # Whether another file names a route is all the rules ask: the least and the greatest path tell it of groups of any size.
    routes = found.join(paths, ["fact_id", "route"]).select("fact_id", F.col("group_id").alias("ordinal"), F.lit("").alias("method"), F.col("route").alias("path"), F.col("path").alias("declared_in"), F.lit(False).alias("is_prefix_composed"), F.array(F.struct(F.col("least").alias("path")), F.struct(F.col("most").alias("path"))).alias("references"))
    own = text.literals(groups).select("repository").distinct()
    return FactTable("RouteFact", {"facts": own.select(*_identity(F.concat(F.lit("routes:"), "repository"), F.col("repository"))), "routes": routes})


def literal_table(groups: DataFrame) -> FactTable:
    """One fact per file with its literals, and those that repeat a separator sign."""
    key = F.concat_ws(":", F.lit("literals"), "repository", "path")
    found = text.separators(groups, minimum=1).select(key.alias("fact_id"), F.col("group_id").alias("ordinal"), "path", "sign", "repetitions")
    return FactTable("StringExpressionFact", {"facts": text.literals(groups).select("repository", "path").distinct().select(*_identity(key, F.col("path"))), "separators": found})
