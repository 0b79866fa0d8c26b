"""Repository history from the text of a version-control log.

The log is the output of `git log --reverse --name-status -M --format=%x01%H%x02%an%x02%at` as a table of lines in their
order: repository, line_no, line. A renamed file's earlier changes count for its last name: the renames are links of a
forest, whose roots are the last names, so chains of any length fold in one pass.

Defined cases: a line before the first commit, of no known form or without a path is left out; repeated lines count
once; a path that is renamed back and forth keeps the name it stands under in each commit; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import forest
from ..session import written


#: Lines one task orders at once.
BLOCK = 200_000


def changes(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """repository, commit, author, at, status, path, former of every changed file.

    A line belongs to the last commit head before it. Heads are carried forward within blocks of lines, and from block to
    block by the last head of each, so a long log is not one task's.
    """
    rows = log.where("line IS NOT NULL").dropDuplicates(["repository", "line_no"])
    head = F.startswith(F.col("line"), F.lit("\x01"))
    parts = F.split(F.substring("line", 2, 1 << 30), "\x02")
    open_ = rows.select("repository", "line_no", "line", F.expr(f"line_no div {block}").alias("block"), F.when(head, parts).alias("head"))
    ends = open_.where("head IS NOT NULL").groupBy("repository", "block").agg(F.max_by("head", "line_no").alias("end"))
    blocks = open_.select("repository", "block").distinct().join(ends, ["repository", "block"], "left")
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("repository").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    own = F.last("head", ignorenulls=True).over(Window.partitionBy("repository", "block").orderBy("line_no"))
    carried = open_.withColumn("own", own).join(blocks.select("repository", "block", before.alias("before")), ["repository", "block"])
    held = carried.withColumn("commit", F.coalesce("own", "before")).where(F.col("head").isNull() & F.col("commit").isNotNull()).withColumn("f", F.split("line", "\t")).where(F.col("f")[0].rlike("^[ACDMRT][0-9]*$") & (F.size("f") > 1))
    renamed = F.col("f")[0].rlike("^[RC]")
    return held.select("repository", F.col("commit")[0].alias("commit"), F.col("commit")[1].alias("author"), F.timestamp_seconds(F.col("commit")[2].cast("long")).alias("at"), F.substring(F.col("f")[0], 1, 1).alias("status"), F.when(renamed, F.try_element_at("f", F.lit(3))).otherwise(F.col("f")[1]).alias("path"), F.when(F.col("f")[0].startswith("R"), F.col("f")[1]).alias("former")).where("path IS NOT NULL AND path <> ''")


def folded(rows: DataFrame) -> DataFrame:
    """The changes under their files' last names."""
    rows = written(rows)
    links = rows.where("former IS NOT NULL").select(F.col("repository").alias("kind"), F.col("former").alias("node"), F.col("path").alias("parent"))
    names = forest.roots(links).where("depth > 0").select(F.col("kind").alias("repository"), F.col("node").alias("path"), F.col("root_id").alias("name"))
    return rows.join(names, ["repository", "path"], "left").select("repository", "commit", "author", "at", "status", F.coalesce("name", "path").alias("path"))


def history(rows: DataFrame, now) -> DataFrame:
    """repository, path, author_count, additional_commit_count, days_since_last_change of every file that was not deleted last.

    additional_commit_count: commits beyond one for each author. now: the time ages are measured to, a column or literal.
    """
    by = rows.groupBy("repository", "path").agg(F.count_distinct("author").alias("author_count"), F.count_distinct("commit").alias("commits"), F.max("at").alias("last"), F.max_by("status", F.struct("at", "commit")).alias("status"))
    return by.where("status <> 'D'").select("repository", "path", "author_count", F.greatest(F.col("commits") - F.col("author_count"), F.lit(0)).alias("additional_commit_count"), F.date_diff(now, "last").cast("long").alias("days_since_last_change"))
