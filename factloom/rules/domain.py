"""Rules over history, comments, prose, coupling and ancestors."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import graphs, history, prose, text as lexical
from ..operators.facts import FactTable
from ..plans import shaping
from ..plans.contracts import Numeric, Result
from ..plans.engine import rule
from .shape import counted, located, measured, text


@rule("ALL-HIST0001", "RepositoryHistoryFact")
def busy_large_files(repositories: FactTable, minimum_lines: int = 400, minimum_commits: int = 2, busy_share: float = 0.5, recent_days: int = 180) -> Result:
    """Large files the team keeps reopening."""
    rows = history.busy(repositories.relation("files"), minimum_lines, minimum_commits, busy_share, recent_days)
    return counted(repositories, located(rows), text(F.col("path"), " has ", F.col("line_count"), " lines and ", F.col("commit_count"), " commits"), (("commits", F.col("commit_count"), "count"),))


@rule("ALL-HIST0002", "RepositoryHistoryFact")
def many_hands(repositories: FactTable, minimum_authors: int = 4, minimum_commits: int = 5) -> Result:
    """Files too many hands have touched."""
    return counted(repositories, located(history.many_hands(repositories.relation("files"), minimum_authors, minimum_commits)), text(F.col("path"), " has ", F.col("author_count"), " authors"))


@rule("ALL-COMM0001", "CommentFact", output="float", policy=Numeric(maximum=20))
def comment_length(files: FactTable, measure: str = "token_count", normalization_max: int = 200, notice_markers: tuple[str, ...] = lexical.NOTICE_MARKERS) -> Result:
    """The largest ordinary comment of a file, in percent of a norm."""
    rows = lexical.comment_length(files.relation("groups"), measure, normalization_max, notice_markers)
    facts = files.facts().join(rows.select(F.concat_ws(":", F.lit("comments"), "repository", "path").alias("fact_id"), "size", "share"), "fact_id", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return shaping.floating(facts, F.col("share"), shaping.findings(facts.where("share > 0"), text("a comment of ", F.col("size"), " tokens"), (("share", F.col("share"), "percentage"),), order=F.lit(0)))


@rule("ALL-COMM0002", "ParsedCommentFact")
def commented_out_code(files: FactTable, minimum_lines: int = 1) -> Result:
    """Comment groups that are code."""
    return counted(files, files.relation("groups").where(F.col("parses_as_source") & (F.coalesce("line_count", F.lit(1)) >= minimum_lines)), text("a comment holds code"))


@rule("ALL-COMM0003", "CommentFact")
def unresolved_work_marker(files: FactTable, markers: tuple[str, ...] = lexical.WORK_MARKERS) -> Result:
    """Comment lines that begin with a work marker."""
    rows = lexical.work_markers(files.relation("groups"), markers).withColumns({"fact_id": F.concat_ws(":", F.lit("comments"), "repository", "path"), "ordinal": F.col("group_id") * 10_000 + F.col("line_in_group")})
    return counted(files, located(rows), text("`", F.col("marker"), "` is open"))


@rule("ALL-WRIT0003", "ProseSegmentFact", output="float", policy=Numeric(maximum=90))
def sentence_length_uniformity(documents: FactTable, minimum_sentences: int = 5, minimum_words: int = 3) -> Result:
    """How alike a document's sentences are in length."""
    facts = documents.facts().join(prose.sentence_uniformity(documents.relation("sections"), minimum_sentences, minimum_words), "fact_id")
    return shaping.floating(facts, F.col("uniformity"), shaping.findings(facts.where("uniformity > 0"), text("sentences are alike"), (("uniformity", F.col("uniformity"), "percentage"),), order=F.lit(0)))


@rule("ALL-WRIT0004", "ProseSegmentFact", output="float", policy=Numeric(maximum=90))
def paragraph_length_uniformity(documents: FactTable, minimum_paragraphs: int = 4, minimum_words: int = 30) -> Result:
    """How alike a document's paragraphs are in length."""
    facts = documents.facts().join(prose.paragraph_uniformity(documents.relation("sections"), minimum_paragraphs, minimum_words), "fact_id")
    return shaping.floating(facts, F.col("uniformity"), shaping.findings(facts.where("uniformity > 0"), text("paragraphs are alike"), (("uniformity", F.col("uniformity"), "percentage"),), order=F.lit(0)))


@rule("ALL-WRIT0005", "ProseSegmentFact", output="float", policy=Numeric(maximum=30))
def sentence_opener_concentration(documents: FactTable, minimum_sentences: int = 6, ignored_openers: tuple[str, ...] = ("a", "i")) -> Result:
    """Greatest share of one opener."""
    facts = documents.facts().join(prose.opener_concentration(documents.relation("sections"), minimum_sentences, ignored_openers), "fact_id")
    return shaping.floating(facts, F.col("share"), shaping.findings(facts.where("share > 0"), text("`", F.col("opener"), "` opens many sentences"), (("share", F.col("share"), "percentage"),), order=F.lit(0)))


@rule("ALL-ARCH0002", "ModuleCouplingFact")
def import_cycles(repositories: FactTable) -> Result:
    """Import cycles of each repository, each with its first closing edge."""
    edges = repositories.relation("edges").select(F.concat_ws("\x00", "fact_id", "source").alias("source"), F.concat_ws("\x00", "fact_id", "target").alias("target"))
    rows = graphs.cycles(edges).select(F.substring_index("component", "\x00", 1).alias("fact_id"), "members", F.substring_index("source", "\x00", -1).alias("source"), F.substring_index("target", "\x00", -1).alias("target")).withColumn("ordinal", F.concat("source", "target"))
    return counted(repositories, located(rows.join(repositories.identity().select("fact_id", "path"), "fact_id")), text(F.col("members"), " modules import each other, as ", F.col("source"), " imports ", F.col("target")))


@rule("ALL-ARCH0003", "ModuleCouplingFact")
def dependency_on_a_less_stable_module(repositories: FactTable, tolerance: float = 0.0) -> Result:
    """Edges from a package to a less stable one."""
    package = lambda c: F.concat_ws("\x00", "fact_id", F.substring_index(c, ".", 1))
    edges = repositories.relation("edges").select(package("source").alias("source"), package("target").alias("target"))
    rows = graphs.unstable_edges(edges, tolerance).select(F.substring_index("source", "\x00", 1).alias("fact_id"), F.substring_index("source", "\x00", -1).alias("source"), F.substring_index("target", "\x00", -1).alias("target")).withColumn("ordinal", F.concat("source", "target"))
    return counted(repositories, located(rows.join(repositories.identity().select("fact_id", "path"), "fact_id")), text(F.col("source"), " depends on the less stable ", F.col("target")))


@rule("ALL-CLAS0005", "OverrideFact", policy=Numeric(maximum=5))
def ancestor_count(classes: FactTable) -> Result:
    """Ancestors of a class; one on a circle is unassessed."""
    n = F.when(F.col("ancestors") >= 0, F.col("ancestors"))
    return measured(classes, n, text(F.col("class_id"), " has ", n, " ancestors"))


@rule("ALL-DATA0010", "LineageEdgeFact")
def unresolved_lineage_endpoint(lineage: FactTable) -> Result:
    """Ends of lineage edges that resolve to no asset."""
    ends = lineage.relation("edges").select("fact_id", "ordinal", F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_exists").alias("there"), F.lit(0).alias("side")), F.struct(F.col("target").alias("name"), F.col("target_exists").alias("there"), F.lit(1).alias("side")))).alias("e")).where("NOT e.there")
    rows = ends.select("fact_id", (F.col("ordinal") * 2 + F.col("e.side")).alias("ordinal"), F.col("e.name").alias("name")).join(lineage.identity().select("fact_id", "path"), "fact_id")
    return counted(lineage, located(rows), text("`", F.col("name"), "` is no asset"))


@rule("ALL-DATA0011", "DataAssetFact", "LineageEdgeFact")
def unowned_high_impact_asset(assets: FactTable, lineage: FactTable, minimum_downstream: int = 3, maximum_depth: int = 3) -> Result:
    """Unowned assets with many distinct ones downstream within some steps."""
    bare = assets.relation("assets").where(~F.exists(F.coalesce("owners", F.array().cast("array<string>")), lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))))
    below = graphs.reach(bare.select(F.col("identifier").alias("node")), lineage.relation("edges"), maximum_depth).where("root <> node").groupBy(F.col("root").alias("identifier")).agg(F.count("*").alias("downstream")).where(F.col("downstream") >= minimum_downstream)
    rows = bare.join(below, "identifier").join(assets.identity().select("fact_id", "path"), "fact_id")
    return counted(assets, located(rows.select("fact_id", "ordinal", "identifier", "downstream", "path")), text("`", F.col("identifier"), "` has no owner and ", F.col("downstream"), " assets below it"))


@rule("ALL-DATA0008", "DataChangeFact", output="float", policy=Numeric(maximum=5))
def data_change_test_gap(changes: FactTable) -> Result:
    """Percentage of pairs of a breaking change and an affected asset (itself included) that no test evidence names."""
    own = changes.relation("changes").where("is_breaking")
    touched = own.select("fact_id", "asset_identifier", F.explode(F.array_union(F.array("asset_identifier"), F.coalesce("downstream_assets", F.array().cast("array<string>")))).alias("affected")).distinct()
    tested = own.select("fact_id", "asset_identifier", F.explode("tested_assets").alias("affected")).distinct()
    keys = ["fact_id", "asset_identifier", "affected"]
    pairs = touched.join(tested.withColumn("met", F.lit(True)), keys, "left").withColumn("gap", F.col("met").isNull())
    rows = pairs.where("gap").withColumn("ordinal", F.concat("asset_identifier", "affected")).join(changes.identity().select("fact_id", "path"), "fact_id")
    return shaping.floating(changes.coverage(pairs, F.col("gap"), "gap_share"), "gap_share", shaping.findings(located(rows), text("no test covers `", F.col("affected"), "`")))


@rule("ALL-CI0002", "CICheckFact", output="float", policy=Numeric(minimum=95))
def feedback_target_coverage(checks: FactTable, target_seconds: int = 600, percentile: float = 0.9) -> Result:
    """Percentage of required checks whose duration at a percentile (nearest rank) meets a target."""
    runs = checks.relation("checks").where("required").select("fact_id", "name", F.explode("durations").alias("seconds"))
    w = Window.partitionBy("fact_id", "name")
    ranked = runs.withColumns({"k": F.row_number().over(w.orderBy("seconds")), "n": F.count("*").over(w)}).where(F.col("k") == F.rint((F.col("n") - 1) * F.lit(percentile)) + 1)
    return shaping.floating(checks.coverage(ranked, F.col("seconds") <= target_seconds), "coverage")


@rule("ALL-FILE0003", "DirectoryFact", policy=Numeric(maximum=3))
def directory_module_count(directories: FactTable) -> Result:
    """Source files directly in a directory."""
    return measured(directories, F.col("files"), text(F.col("path"), " holds ", F.col("files"), " files"))


@rule("ALL-FILE0002", "DirectoryFact", policy=Numeric(maximum=5))
def package_depth(directories: FactTable) -> Result:
    """Depth of a directory below the root."""
    return measured(directories, F.col("depth"), text(F.col("path"), " is ", F.col("depth"), " deep"))


@rule("ALL-FILE0004", "DirectoryFact", output="boolean")
def directory_pathway(directories: FactTable) -> Result:
    """A directory that holds one directory and nothing else."""
    from .shape import flag

    return flag(directories, (F.col("files") == 0) & (F.col("directories") == 1), text(F.col("path"), " only leads on"))
