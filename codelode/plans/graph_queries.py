"""Import graph, commit graph, file history and trees. lineitem is imports (supplier imports part; returned ones are external)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import graph
from codelode.plans.registry import query


def _deps(t):
    external = F.col("l_returnflag") == "R"
    return t("lineitem").select(F.concat(F.lit("f"), "l_suppkey").alias("source"), F.when(~external, F.concat(F.lit("f"), F.col("l_partkey") % 400)).alias("target"), F.concat(F.lit("i"), "l_linenumber").alias("import_name"), F.when(external, F.concat(F.lit("pkg"), F.col("l_partkey") % 50)).alias("package"), F.concat(F.lit("v"), F.col("l_linenumber")).alias("version"))


_DEPS = "SELECT 'f' || l_suppkey AS source, CASE WHEN l_returnflag <> 'R' THEN 'f' || (l_partkey % 400) END AS target, 'i' || l_linenumber AS import_name, CASE WHEN l_returnflag = 'R' THEN 'pkg' || (l_partkey % 50) END AS package, 'v' || l_linenumber AS version FROM lineitem"


@query(f"SELECT package, version, count(*) AS import_count, count(DISTINCT source) AS file_count FROM ({_DEPS}) WHERE target IS NULL AND package IS NOT NULL GROUP BY package, version")
def external_packages(t):
    return graph.external_packages(_deps(t), ["package", "version"], "source", "target")


@query(f"SELECT file_path, sum(o)::BIGINT AS imports_count, sum(i)::BIGINT AS imported_by_count FROM (SELECT source AS file_path, 1 AS o, 0 AS i FROM ({_DEPS}) UNION ALL SELECT target, 0, 1 FROM ({_DEPS}) WHERE target IS NOT NULL) GROUP BY file_path")
def file_dependency_counts(t):
    return graph.dependency_counts(_deps(t), "source", "target")


@query(f"SELECT count(DISTINCT f) AS total FROM (SELECT source AS f FROM ({_DEPS}) UNION SELECT target FROM ({_DEPS}) WHERE target IS NOT NULL)")
def files_with_deps_count(t):
    return graph.files_with_dependencies(_deps(t), "source", "target")


@query(f"SELECT source, target, import_name FROM ({_DEPS}) WHERE source = 'f17'")
def deps_from(t):
    return _deps(t).where("source = 'f17'").select("source", "target", "import_name").orderBy("import_name")


@query(f"SELECT source, target, import_name FROM ({_DEPS}) WHERE target = 'f3'")
def deps_to(t):
    return _deps(t).where("target = 'f3'").select("source", "target", "import_name").orderBy("source", "import_name")


@query(f"SELECT source, target, count(*) AS n FROM ({_DEPS}) WHERE source IN ('f1', 'f2', 'f3') GROUP BY ALL")
def deps_from_many(t):
    return _deps(t).where(F.col("source").isin("f1", "f2", "f3")).groupBy("source", "target").agg(F.count("*").alias("n"))


_SMALL = "SELECT 's' || (l_suppkey % 90) AS source, CASE WHEN l_returnflag <> 'R' THEN 's' || (l_partkey % 900) END AS target, 'i' || l_linenumber AS import_name, CASE WHEN l_returnflag = 'R' THEN 'pkg' || (l_partkey % 7) END AS package FROM lineitem"


def _small(t):
    external = F.col("l_returnflag") == "R"
    return t("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey") % 90).alias("source"), F.when(~external, F.concat(F.lit("s"), F.col("l_partkey") % 900)).alias("target"), F.concat(F.lit("i"), "l_linenumber").alias("import_name"), F.when(external, F.concat(F.lit("pkg"), F.col("l_partkey") % 7)).alias("package"))


@query(f"""WITH RECURSIVE e AS (SELECT source, coalesce(target, 'ext:' || coalesce(package, import_name)) AS target, target IS NULL AS ext FROM ({_SMALL})),
step AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e WHERE NOT ext),
walk AS (SELECT 's5' AS node, 0 AS depth UNION SELECT step.b, walk.depth + 1 FROM walk JOIN step ON step.a = walk.node WHERE walk.depth < 2 AND walk.node NOT LIKE 'ext:%')
SELECT node AS file_path, node LIKE 'ext:%' AS is_external, min(depth) AS depth FROM walk GROUP BY node""")
def deps_bfs(t):
    return graph.bfs(_small(t), "s5", 2, max_nodes=100_000)[0]


@query()
def deps_bfs_capped(t):
    nodes, edges, _ = graph.bfs(_deps(t), "f5", 3)
    return edges.join(nodes.select(F.col("file_path").alias("target"), "depth"), "target")


@query(f"SELECT DISTINCT source, target, import_name FROM ({_DEPS})")
def edge_dedup(t):
    return graph.dedup_edges(_deps(t).select("source", "target", "import_name"), ["source", "target", "import_name"])


@query("""WITH p AS (SELECT string_split(trim(regexp_replace(url, '^https?://', ''), '/'), '/') AS parts FROM pages), x AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS d FROM p)
SELECT path, parent, name, depth, CASE WHEN bool_or(f) THEN 'file' ELSE 'directory' END AS type FROM (SELECT array_to_string(parts[1:d], '/') AS path, array_to_string(parts[1:d - 1], '/') AS parent, parts[d] AS name, d AS depth, d = len(parts) AS f FROM x) GROUP BY ALL""")
def file_tree(t):
    return graph.path_nodes(t("pages").select(F.regexp_replace("url", "^https?://", "").alias("url")), "url")


@query("SELECT d.doc_id AS file_id, d.lang AS language, l.quality, l.doc_id IS NOT NULL AS has_content FROM documents d LEFT JOIN labels l USING (doc_id)")
def file_context_left_join(t):
    held = t("labels").select("doc_id", "quality", F.lit(True).alias("held"))
    return t("documents").select("doc_id", "lang").join(held, "doc_id", "left").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("language"), "quality", F.coalesce("held", F.lit(False)).alias("has_content"))


@query("SELECT l_orderkey AS commit_id, o_orderdate AS committed, CAST(l_quantity AS BIGINT) AS additions, l_linenumber AS deletions FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = 77 OR l_partkey = 177 ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber LIMIT 10")
def file_history_by_path(t):
    diffs = t("lineitem").where("l_partkey = 77 OR l_partkey = 177").select("l_orderkey", F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").alias("deletions"))
    return diffs.join(t("orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey")).orderBy(F.desc("o_orderdate"), F.desc("l_orderkey"), "deletions").limit(10).select(F.col("l_orderkey").alias("commit_id"), F.col("o_orderdate").alias("committed"), "additions", "deletions")


@query("SELECT o_orderkey AS commit_id, count(l_orderkey) AS files, coalesce(sum(l_quantity), 0)::BIGINT AS additions, coalesce(sum(l_linenumber), 0)::BIGINT AS deletions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def commit_diff_stats(t):
    stats = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("files"), F.sum("l_quantity").cast("long").alias("additions"), F.sum("l_linenumber").alias("deletions"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return t("orders").select("o_orderkey").join(stats, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("commit_id"), zero("files"), zero("additions"), zero("deletions"))


_EDGES = "SELECT o_orderkey AS child, o_orderkey - 1 AS parent, 0 AS ordinal FROM orders UNION ALL SELECT o_orderkey, o_orderkey - 7, 1 FROM orders WHERE o_orderkey % 10 = 0"


def _edges(t):
    o = t("orders")
    return o.select(F.col("o_orderkey").alias("child"), (F.col("o_orderkey") - 1).alias("parent"), F.lit(0).alias("ordinal")).unionByName(o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("child"), (F.col("o_orderkey") - 7).alias("parent"), F.lit(1).alias("ordinal")))


@query(f"SELECT child, parent, ordinal, o_orderdate AS committed FROM ({_EDGES}) JOIN orders ON o_orderkey = parent")
def commit_parents(t):
    commits = t("orders").select("o_orderkey", F.col("o_orderdate").alias("committed"))
    return graph.parents(_edges(t), commits, "child", "parent", "o_orderkey").drop("o_orderkey")


@query(f"SELECT parent, child FROM ({_EDGES}) JOIN orders ON o_orderkey = child WHERE parent = 500")
def commit_children(t):
    return _edges(t).where("parent = 500").join(t("orders").select(F.col("o_orderkey").alias("child")), "child").select("parent", "child")
