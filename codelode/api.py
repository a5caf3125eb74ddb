"""The read surface over a store: searches, symbols, graphs, files, history, jobs and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import predicates as P
from codelode.functions import text as T
from codelode.operators import access, graph, health, search, vectors
from codelode.store import Store


class Api:
    """Each method answers one kind of request; as_of is the time that relative times are reckoned from."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def active_snapshot(self, project: str, branch: str | None = None) -> str | None:
        """The project's active snapshot, the latest of several branches'."""
        rows = self.store.where("index_snapshots", project_id=project, is_active=True, **({"branch": branch} if branch else {}))
        first = rows.orderBy(F.col("activated_at").desc_nulls_last(), F.desc("id")).limit(1).collect()
        return first[0]["id"] if first else None

    def rows(self, name: str, project: str, **equal: object) -> DataFrame:
        """Rows of the project's active snapshot; none if there is none. The literal snapshot prunes the directories read."""
        return self.store.where(name, project_id=project, index_snapshot_id=self.active_snapshot(project) or "", **equal)

    def _with_path(self, rows: DataFrame, project: str) -> DataFrame:
        files = self.rows("files", project).select(F.col("id").alias("file_id"), "file_path", "language")
        return rows.join(files, "file_id")

    def search(self, project: str, query: str, mode: str = "insensitive", language: str | None = None, file_pattern: str | None = None, include: str | None = None, exclude: str | None = None) -> search.Result:
        """Code chunks with a text or pattern, and how often."""
        rows = self._with_path(self.rows("code_chunks", project), project)
        return search.search_content(rows, query, mode, content="content", key="id", path="file_path", language=("language", language) if language else None, file_pattern=file_pattern, include=include, exclude=exclude)

    def symbols(self, project: str, name: str = "", mode: str = "insensitive", kind: str | None = None, include: str | None = None, exclude: str | None = None) -> search.Result:
        return search.search_symbols(self._with_path(self.rows("symbols", project), project), name, mode, kind=("kind", kind) if kind else None, include=include, exclude=exclude)

    def symbol(self, project: str, symbol_id: str) -> DataFrame:
        return self._with_path(self.rows("symbols", project, id=symbol_id), project)

    def symbol_children(self, project: str, symbol_id: str) -> DataFrame:
        return self._with_path(self.rows("symbols", project, parent_symbol_id=symbol_id), project).orderBy("start_line", "id")

    def dependencies(self, project: str) -> DataFrame:
        return graph.dependency_counts(self.rows("dependencies", project), "source_file_path", "target_file_path").orderBy("file_path")

    def external_packages(self, project: str) -> DataFrame:
        return graph.external_packages(self.rows("dependencies", project), ["package_name", "package_version"], "source_file_path", "target_file_path")

    def file_dependencies(self, project: str, path: str) -> tuple[DataFrame, DataFrame]:
        """What a file imports, and what imports it."""
        rows = self.rows("dependencies", project)
        return rows.where(F.col("source_file_path") == path).orderBy("import_name"), rows.where(F.col("target_file_path") == path).orderBy("source_file_path", "import_name")

    def dependency_graph(self, project: str, root: str, depth: int = graph.DEFAULT_DEPTH) -> tuple[DataFrame, DataFrame, bool]:
        edges = self.rows("dependencies", project).select(F.col("source_file_path").alias("source"), F.col("target_file_path").alias("target"), "import_name", F.col("package_name").alias("package"))
        return graph.bfs(edges, root, depth)

    def structure(self, project: str) -> DataFrame:
        files = self.rows("files", project).select(F.col("file_path").alias("p"), "language", "line_count", "size_bytes")
        return graph.path_nodes(files, "p", ["language", "line_count", "size_bytes"]).orderBy(*graph.tree_order())

    def file(self, project: str, path: str) -> dict | None:
        """A file's row with its content if that was stored."""
        f = self.rows("files", project, file_path=path)
        contents = self.store.where("file_contents", project_id=project).select(F.col("content_hash").alias("file_content_id"), "content")
        row = f.join(contents, "file_content_id", "left").limit(1).collect()
        return row[0].asDict(True) if row else None

    def artifacts(self, project: str, path: str, table: str) -> DataFrame:
        """Rows of one table (symbols, code_chunks, exports, symbol_references, jsx_usages, network_calls) of one file, by place."""
        line = "line" if table in ("exports", "jsx_usages") else "start_line"
        return self._with_path(self.rows(table, project), project).where(F.col("file_path") == path).orderBy(line, "id")

    def similar(self, project: str, text: str, k: int = 10, where: Column | None = None) -> DataFrame:
        """The chunks nearest to a text by cosine."""
        vector = vectors.embed(self.spark.createDataFrame([(text,)], "t string"), "t").first()["embedding"]
        return vectors.top_k(self.rows("vectors", project), vector, k, key="id", where=where)

    def commits(self, project: str, message: str = "", since: str | None = None, until: str | None = None, role: str = "member") -> search.Result:
        """Commits, newest first; addresses are shown to admins and owners only."""
        rows = self.store.where("commits", project_id=project).withColumns({"short_hash": T.short_hash(F.col("commit_hash")), "subject": T.subject(F.col("message"))})
        rows = rows.withColumns({c: T.masked_email(F.col(c), F.lit(role)) for c in ("author_email", "committer_email")})
        return search.search_commits(rows, message, since=since, until=until)

    def commit_parents(self, project: str, commit: str) -> DataFrame:
        edges = self.store.where("commit_parents", project_id=project, commit_id=commit).select("parent_commit_id", "ordinal")
        return edges.join(self.store.where("commits", project_id=project), F.col("parent_commit_id") == F.col("id")).orderBy("ordinal")

    def commit_children(self, project: str, commit: str) -> DataFrame:
        edges = self.store.where("commit_parents", project_id=project, parent_commit_id=commit).select("commit_id", "ordinal")
        return edges.join(self.store.where("commits", project_id=project), F.col("commit_id") == F.col("id")).orderBy(F.desc("committer_date"), "id")

    def commit_diffs(self, project: str, commit: str, patches: bool = False) -> DataFrame:
        """Changed files of a commit; patches are read only when asked for."""
        rows = self.store.where("commit_file_diffs", project_id=project, commit_id=commit)
        return (rows if patches else rows.drop("patch")).orderBy(F.coalesce("new_file_path", "old_file_path"))

    def commit_stats(self, project: str, commit: str) -> DataFrame:
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        return self.store.where("commit_file_diffs", project_id=project, commit_id=commit).agg(F.count("*").alias("files_changed"), zero("additions"), zero("deletions"))

    def file_history(self, project: str, path: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
        n, skip = P.page(limit, offset, 10, 50)
        diffs = self.store.where("commit_file_diffs", project_id=project).where((F.col("new_file_path") == path) | (F.col("old_file_path") == path)).drop("patch", "id")
        commits = self.store.where("commits", project_id=project).select(F.col("id").alias("commit_id"), "commit_hash", "committer_date", "message")
        return diffs.join(commits, "commit_id").orderBy(F.desc("committer_date"), F.desc("commit_id")).offset(skip).limit(n)

    def jobs(self, project: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return self.store.listing("indexing_jobs", [F.desc("created_at"), F.desc("id")], limit, offset, project_id=project)

    def _mine(self, name: str, user: str) -> DataFrame:
        mine = self.store.where("project_members", user_id=user).select("project_id")
        return self.store.table(name).join(mine, "project_id", "left_semi")

    def projects(self, user: str | None, as_of: Column) -> DataFrame:
        """Projects (a user's, or all) with health and its place by severity."""
        projects = self.store.table("projects").withColumnRenamed("id", "project_id")
        if user is not None:
            projects = projects.join(self.store.where("project_members", user_id=user).select("project_id", "role"), "project_id")
        jobs = self.store.table("indexing_jobs").withColumnRenamed("id", "job_id")
        recent = jobs.where((F.col("status") != "failed") | health.since(F.col("finished_at"), as_of, "24 hours"))
        rows = health.project_health(projects, self.store.table("index_snapshots").withColumnRenamed("id", "snapshot_id"), recent)
        status = health.health_status(F.col("active_job_id"), F.col("failed_job_id"), F.col("activated_at"), as_of)
        return projects.join(rows.withColumn("health", status), "project_id").orderBy(health.severity(F.col("health")), "name", "project_id")

    def dashboard(self, user: str, as_of: Column) -> dict:
        """Projects, active jobs, failures and query latency of the last 24 hours, of a user's projects."""
        jobs = self._mine("indexing_jobs", user)
        counts = jobs.agg(F.count_if(F.col("status").isin(*health.ACTIVE)).alias("active_jobs"), F.count_if((F.col("status") == "failed") & health.since(F.col("finished_at"), as_of, "24 hours")).alias("failed_jobs_24h")).first()
        log = self._mine("query_log", user)
        return {"projects": self.store.count("project_members", user_id=user), **counts.asDict(), **health.p95(log.where(health.since(F.col("created_at"), as_of, "24 hours")), "latency_ms").first().asDict()}

    def users(self, text: str = "", active: bool | None = None, by: str = "created_at", limit: int | None = None, offset: int | None = None) -> DataFrame:
        rows = self.store.table("users")
        if text:
            rows = rows.where(F.col("username").ilike(text) | F.col("display_name").ilike(text))
        if active is not None:
            rows = rows.where(F.col("is_active") == active)
        listed = access.list_users(rows.withColumnRenamed("id", "user_id"), self.store.table("project_members"), self.store.table("user_platform_roles"))
        n, skip = P.page(limit, offset, 20, 100)
        return listed.orderBy(*([F.asc("username")] if by == "username" else []), F.desc("created_at"), F.asc("user_id")).offset(skip).limit(n)

    def key_access(self, key_hash: str, project: str, as_of: Column) -> str | None:
        """The role that a key has in a project; None if it has none."""
        keys = self.store.where("api_keys", key_hash=key_hash).withColumnRenamed("id", "api_key_id")
        row = access.key_access(keys, self.store.where("project_members", project_id=project), as_of).where(F.col("project_id") == project).limit(1).collect()
        return row[0]["effective_role"] if row else None
