"""Indexing of a file tree to a snapshot: in full, or from the last one by what changed. Both give the same rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.functions.text import null_if_empty
from codelode.operators import resolve, snapshots, vectors
from codelode.parse import engine
from codelode.parse.languages import detect_column, parsed_column
from codelode.store import Store

#: Result tables of parsing and the logical tables that they become, with the column that names a row in its file.
ARTIFACTS = {"symbols": ("symbols", "symbol_id"), "exports": ("exports", "export_id"), "references": ("symbol_references", "reference_id"), "jsx_usages": ("jsx_usages", "usage_id"), "network_calls": ("network_calls", "network_call_id")}
_LINKS = ("symbol_id", "parent_symbol_id", "source_symbol_id", "resolved_target_symbol_id")


def snapshot_id(project: str, branch: str, version: str, commit: str) -> str:
    return hashlib.sha256(":".join((project, branch, version, commit)).encode()).hexdigest()[:32]


def _id(snapshot: str, *parts):
    return F.sha2(F.concat_ws(":", F.lit(snapshot), *parts), 256)


def artifacts(files: DataFrame, project: str, snapshot: str, paths: DataFrame, go_module: str = "", held: list[DataFrame] | None = None) -> dict[str, DataFrame]:
    """The logical tables of files (file_path, content) under a snapshot. paths are all files of the project.

    With held, what parsing gives is kept for all tables and added to that list, whose owner releases it.

    Files without a parser are cut to raw chunks. Ids are hashes of the snapshot and what a row is, so a second run writes the same.
    """
    own = F.lit(project).alias("project_id"), F.lit(snapshot).alias("index_snapshot_id")
    with_parser = parsed_column(F.col("file_path"))
    parsed = engine.parse(files.where(with_parser))
    if held is not None:
        held.append(parsed.persist())
    raw = files.where(~with_parser)
    file_id = _id(snapshot, F.col("file"))
    meta = parsed.select("file_path", null_if_empty(F.col("language")).alias("language"), null_if_empty(F.col("file_hash")).alias("file_hash"), "size_bytes", "line_count", F.to_json("facts").alias("file_facts"), F.to_json("issues").alias("issues"), F.to_json("extractor_statuses").alias("extractor_statuses"))
    text = T.normalize_newlines(F.col("content"))
    meta = meta.unionByName(raw.select("file_path", detect_column(F.col("file_path")).alias("language"), F.sha2(text, 256).alias("file_hash"), F.octet_length(text).cast("long").alias("size_bytes"), T.count_lines(text).cast("int").alias("line_count")), allowMissingColumns=True)
    out = {"files": meta.select(_id(snapshot, F.col("file_path")).alias("id"), *own, "*", F.col("file_hash").alias("file_content_id"))}
    for source, (name, key) in ARTIFACTS.items():
        rows = engine.explode(parsed, source)
        link = {c: F.when(F.col(c) != "", _id(snapshot, F.col("file"), F.col(c))) for c in _LINKS if c in rows.columns and c != key}
        row_id = _id(snapshot, F.col("file"), F.col(key), *([F.col("line")] if source == "exports" else []))
        rows = rows.withColumns({"id": row_id, "file_id": file_id, **link})
        out[name] = rows.withColumn("flags", F.to_json("flags")).select("*", *own) if source == "symbols" else rows.select("*", *own)
    imports = engine.explode(parsed, "imports").join(parsed.select(F.col("file_path").alias("file"), "language"), "file")
    found = resolve.resolve_imports(imports, paths.select(F.col("file_path").alias("path")), go_module)
    out["dependencies"] = found.select(_id(snapshot, F.col("file"), F.col("import_name"), F.col("import_type")).alias("id"), *own, F.col("file").alias("source_file_path"), null_if_empty(F.col("target_file_path")).alias("target_file_path"), "import_name", "import_type", null_if_empty(F.col("package_name")).alias("package_name"), null_if_empty(F.col("package_version")).alias("package_version"))
    chunks = engine.explode(parsed, "chunks").select("file", "symbol_id", "chunk_type", "content", "context_before", "start_line", "end_line", "owner_qualified_name", "owner_kind", "is_exported_context", "semantic_role")
    pieces = engine.raw_chunks(raw.where("content <> ''").withColumn("text", text), "file_path", "text")
    chunks = chunks.unionByName(pieces.select(F.col("key").alias("file"), "content", F.lit("raw").alias("chunk_type"), "start_line", "end_line"), allowMissingColumns=True)
    link = F.when(F.coalesce("symbol_id", F.lit("")) != "", _id(snapshot, F.col("file"), F.col("symbol_id")))
    out["code_chunks"] = chunks.select(_id(snapshot, F.col("file"), F.col("chunk_type"), F.col("start_line"), F.col("end_line")).alias("id"), *own, file_id.alias("file_id"), link.alias("symbol_id"), "chunk_type", F.sha2("content", 256).alias("chunk_hash"), "content", null_if_empty(F.col("context_before")).alias("context_before"), "start_line", "end_line", T.estimate_tokens(F.col("content")).cast("int").alias("estimated_tokens"), null_if_empty(F.col("owner_qualified_name")).alias("owner_qualified_name"), null_if_empty(F.col("owner_kind")).alias("owner_kind"), F.coalesce("is_exported_context", F.lit(False)).alias("is_exported_context"), null_if_empty(F.col("semantic_role")).alias("semantic_role"), F.col("file").alias("file_path"))
    out["vectors"] = vectors.embed(out["code_chunks"].select("id", *own, "file_path", "chunk_type", "start_line", "end_line", "content"), "content").drop("content")
    return out


def index(store: Store, project: str, branch: str, commit: str, files: DataFrame, version: str = "hashed-64", go_module: str = "") -> str:
    """Index files (file_path, content) as the branch's new active snapshot and return its id.

    With an active snapshot of the same embedding version, only added and modified files are parsed; of the rest rows are carried
    forward under new ids. Imports of carried files keep their targets.
    """
    spark, new = store.spark, snapshot_id(project, branch, version, commit)
    active = store.get("index_snapshots", project_id=project, branch=branch, is_active=True) or {}
    mode = snapshots.incremental_base(active.get("id"), active.get("embedding_version_id") == version, active.get("id") != new)
    files = files.select("file_path", "content")
    now = files.select(F.col("file_path").alias("path"), F.sha2(T.normalize_newlines(F.col("content")), 256).alias("hash"))
    todo, carried, held = files, {}, []
    if mode == "incremental":
        old = active["id"]
        before = store.where("files", project_id=project, index_snapshot_id=old)
        change = snapshots.classify(before.select(F.col("file_path").alias("path"), F.coalesce("file_hash", F.sha2(F.lit(""), 256)).alias("hash")), now)
        todo = files.join(change.where("change IN ('A', 'M')").select(F.col("path").alias("file_path")), "file_path", "left_semi")
        same = before.join(change.where("change = 'U'").select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("__file"), "file_path")
        fresh = artifacts(todo, project, new, files, go_module, held)
        for name in fresh:
            rows = store.where(name, project_id=project, index_snapshot_id=old)
            path = "source_file_path" if name == "dependencies" else "file_path" if "file_path" in rows.columns else None
            keep = rows.join(same.select(F.col("file_path").alias(path)) if path else same.select(F.col("__file").alias("file_id"), F.col("file_path").alias("__path")), path or "file_id", "inner" if not path else "left_semi")
            carried[name] = keep.withColumn("index_snapshot_id", F.lit(new)).withColumns(_renamed(keep, name, old, new))
    else:
        fresh = artifacts(todo, project, new, files, go_module, held)
    for name, rows in fresh.items():
        store.replace_snapshots(name, store._shaped(name, rows).unionByName(store._shaped(name, carried[name])) if name in carried else rows)
    for df in held:
        df.unpersist()
    rows = spark.createDataFrame([(new, project, branch, version, commit, False, "building")], "id string, project_id string, branch string, embedding_version_id string, git_commit string, is_active boolean, status string")
    store.insert("index_snapshots", rows, ["id"])
    table = store.table("index_snapshots").withColumnRenamed("id", "snapshot_id")
    store.replace("index_snapshots", snapshots.activate(table, new, F.current_timestamp()).withColumnRenamed("snapshot_id", "id"))
    return new


def _renamed(rows: DataFrame, name: str, old: str, new: str) -> dict:
    """New values of the ids of carried rows: a hash of the new snapshot and the old id, the same wherever the id is named."""
    ids = ["id"] + [c for c in ("file_id", *_LINKS) if c in rows.columns]
    return {c: F.when(F.col(c).isNotNull(), F.sha2(F.concat_ws(":", F.lit(new), F.lit("carried"), F.col(c)), 256)) for c in ids}
