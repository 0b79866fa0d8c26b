"""Repositories and records as source tables, and sinks for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Directories a walk leaves out, and suffixes it reads.
IGNORED = ("/.git/", "/node_modules/", "/__pycache__/", "/.venv/", "/target/", "/dist/")
SUFFIXES = ("py", "ts", "js", "rs", "cpp", "h", "hpp", "md", "toml", "json", "yml", "yaml")


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text; bytes that are none become replacement signs."""
    return F.decode(content, "UTF-8")


def walk(spark: SparkSession, root: str, repository: str, suffixes: tuple[str, ...] = SUFFIXES, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """file_id, repository, path (below the root), byte_count, text of every file with a listed suffix. file_id is a hash of repository and path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    below = F.regexp_replace("path", r"^(?:file:)?/*", "/")
    start = "/" + root.removeprefix("file:").strip("/") + "/"
    path = F.substring(below, len(start) + 1, 1 << 30)
    kept = files.withColumn("p", path)
    for part in ignored:
        kept = kept.where(~F.concat(F.lit("/"), "p").contains(part))
    return kept.select(F.xxhash64(F.lit(repository), "p").alias("file_id"), F.lit(repository).alias("repository"), F.col("p").alias("path"), F.col("length").alias("byte_count"), decoded(F.col("content")).alias("text"), F.col("modificationTime").alias("ingested_at"))


def directories(files: DataFrame) -> DataFrame:
    """directory, files, directories below it, depth; from the files' paths."""
    parts = F.split("path", "/")
    levels = files.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).where(F.col("k") < F.size(F.split("path", "/")))
    every = levels.select(F.array_join(F.slice(F.split("path", "/"), 1, F.col("k")), "/").alias("directory"), F.when(F.size(F.split("path", "/")) == F.col("k") + 1, F.col("path")).alias("file"), F.when(F.size(F.split("path", "/")) > F.col("k") + 1, F.element_at(F.split("path", "/"), (F.col("k") + 1).cast("int"))).alias("sub"), F.col("k").alias("depth"))
    return every.groupBy("directory", "depth").agg(F.count_distinct("file").alias("files"), F.count_distinct("sub").alias("directories"))


def pathways(found: DataFrame) -> DataFrame:
    """Directories that hold one directory and nothing else."""
    return found.where("files = 0 AND directories = 1")


def fingerprint(files: DataFrame) -> DataFrame:
    """repository, fingerprint: one hash over all its paths and texts, independent of their order."""
    one = F.sha2(F.concat_ws("\x00", "path", F.coalesce("text", F.lit(""))), 256)
    return files.dropDuplicates(["repository", "path"]).groupBy("repository").agg(F.count("*").alias("files"), F.bit_xor(F.conv(F.substring(one, 1, 15), 16, 10).cast("long")).alias("fingerprint"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with a stated schema; nothing is inferred, a malformed record is kept with nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def node_link(edges: DataFrame, form: str = "mermaid", limit: int = 500) -> str:
    """A diagram of at most `limit` edges as Mermaid or D2 text. Diagrams are for readers; the limit is part of them, and a diagram says what it leaves out."""
    every = edges.select("source", "target").distinct()
    rows = [(r["source"], r["target"]) for r in every.orderBy("source", "target").limit(limit + 1).collect()]
    left = every.count() - limit if len(rows) > limit else 0
    rows = rows[:limit]
    names = {n: f"n{k}" for k, n in enumerate(sorted({x for r in rows for x in r}))}
    if form == "d2":
        return "\n".join([*[f"# {left} further edges"] * bool(left), *(f'{k}: "{n}"' for n, k in names.items()), *(f"{names[a]} -> {names[b]}" for a, b in rows)])
    return "\n".join(["flowchart LR", *[f"  %% {left} further edges"] * bool(left), *(f'  {k}["{n}"]' for n, k in names.items()), *(f"  {names[a]} --> {names[b]}" for a, b in rows)])
