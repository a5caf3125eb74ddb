"""Import graph, commit graph and file tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES, DEFAULT_DEPTH = 5, 200, 2


def external_packages(deps: DataFrame, package: list[str], source: str, target: str) -> DataFrame:
    """Per package that no file of the project provides: imports and importing files, most imported first."""
    rows = deps.where(F.col(target).isNull() & F.col(package[0]).isNotNull())
    return rows.groupBy(*package).agg(F.count("*").alias("import_count"), F.count_distinct(source).alias("file_count")).orderBy(F.desc("import_count"), *package)


def dependency_counts(deps: DataFrame, source: str, target: str) -> DataFrame:
    """file_path, imports_count and imported_by_count, by one aggregation over both ends of each edge."""
    ends = F.array(F.struct(F.col(source).alias("file_path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(target).alias("file_path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    rows = deps.select(F.explode(ends).alias("e")).select("e.*").where((F.col("o") == 1) | F.col("file_path").isNotNull())
    return rows.groupBy("file_path").agg(F.sum("o").cast("long").alias("imports_count"), F.sum("i").cast("long").alias("imported_by_count"))


def files_with_dependencies(deps: DataFrame, source: str, target: str) -> DataFrame:
    ends = deps.select(F.explode(F.array(source, target)).alias("file_path")).where("file_path is not null")
    return ends.agg(F.count_distinct("file_path").alias("total"))


def dedup_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.dropDuplicates(keys)


def bfs(edges: DataFrame, root: str, depth: int = DEFAULT_DEPTH, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes within depth of root over imports in both directions, the edges met, and whether max_nodes cut it short.

    edges (source, target, import_name, package): target is null for what lies outside the project, which counts as the node
    ext:<package or import name> and is not walked on from. At most max_nodes nodes are ever taken, forward edges first in order
    of source and name, then backward ones of target and source; so the frontier that reaches the driver is bounded by max_nodes,
    each level filters the edges by a literal list (pushed to the scan), and nothing grows with the graph.
    """
    spark = edges.sparkSession
    seen, frontier, met, truncated = {root: 0}, [root], [], False
    e = edges.select("source", F.coalesce("target", F.concat(F.lit("ext:"), F.coalesce("package", "import_name"))).alias("target"), F.col("target").isNull().alias("external"), "import_name")
    for level in range(1, min(depth, MAX_DEPTH) + 1):
        if not frontier or truncated:
            break
        forward, back = e.where(F.col("source").isin(frontier)), e.where(F.col("target").isin(frontier) & ~F.col("external"))
        met += [forward, back]
        # a level brings at most max_nodes + 1 new names in order of first appearance; more cannot be taken
        steps = forward.select(F.lit(0).alias("way"), F.col("source").alias("a"), F.col("import_name").alias("b"), F.col("target").alias("c"), F.col("target").alias("node"), "external")
        steps = steps.unionByName(back.select(F.lit(1).alias("way"), F.col("target").alias("a"), F.col("source").alias("b"), F.col("import_name").alias("c"), F.col("source").alias("node"), F.lit(False).alias("external")))
        first = steps.where(~F.col("node").isin(list(seen))).groupBy("node").agg(F.min(F.struct("way", "a", "b", "c")).alias("at"), F.max("external").alias("external"))
        new = first.select("node", "external", "at.*").orderBy("way", "a", "b", "c", "node").limit(max_nodes + 1).collect()
        room = max_nodes - len(seen)
        truncated = len(new) > room
        seen |= {r["node"]: level for r in new[:room]}
        frontier = [r["node"] for r in new[:room] if not r["external"]]
    nodes = spark.createDataFrame([(n, n.startswith("ext:"), d) for n, d in seen.items()], "file_path string, is_external boolean, depth int")
    out = spark.createDataFrame([], "source string, target string, import_name string")
    for part in met:
        out = out.unionByName(part.select("source", "target", "import_name"))
    out = out.dropDuplicates(["source", "target", "import_name"])
    if truncated:
        out = out.where(F.col("source").isin(list(seen)) & F.col("target").isin(list(seen)))
    return nodes, out, truncated


def parents(edges: DataFrame, commits: DataFrame, child: str, parent: str, key: str) -> DataFrame:
    """Parent commits of each child."""
    return edges.join(commits, F.col(parent) == F.col(key))


def path_nodes(files: DataFrame, path: str, extra: list[str] = ()) -> DataFrame:
    """A node for every file and every directory above one: path, parent, name, type and depth.

    Nesting is left to the edge of the system: rows have no recursive types.
    """
    parts = F.split(F.trim(F.col(path), F.lit("/")), "/")
    each = files.where(F.length(path) > 0).select(*extra, parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    at = each.select(*extra, F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"), F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/").alias("parent"), F.element_at("parts", F.col("depth")).alias("name"), (F.col("depth") == F.size("parts")).alias("is_file"), "depth")
    return at.groupBy("path", "parent", "name", "depth").agg(F.when(F.max("is_file"), "file").otherwise("directory").alias("type"), *[F.max(F.when(F.col("is_file"), F.col(c))).alias(c) for c in extra])


def tree_order() -> list[Column]:
    """Directories before files, then by name."""
    return [F.col("parent"), F.col("type") == "file", F.col("name")]
