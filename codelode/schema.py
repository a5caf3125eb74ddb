"""The logical tables, as Spark DDL. Ids are strings (hashes of natural keys), JSON columns are strings, times are in UTC."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: Tables and their columns. created_at and updated_at are left to the writer and may be null.
TABLES: dict[str, str] = {
    "users": "id string, username string, email string, display_name string, avatar_url string, is_active boolean, created_at timestamp, updated_at timestamp",
    "user_platform_roles": "id string, user_id string, role string, granted_by string, created_at timestamp",
    "projects": "id string, name string, repo_url string, default_branch string, status string, created_by string, selected_embedding_global_config_id string, selected_llm_global_config_id string, created_at timestamp, updated_at timestamp",
    "project_members": "id string, project_id string, user_id string, role string, invited_by string, created_at timestamp, updated_at timestamp",
    "ssh_keys": "id string, name string, public_key string, private_key_encrypted binary, key_type string, fingerprint string, is_active boolean, created_by string, created_at timestamp, rotated_at timestamp",
    "project_ssh_key_assignments": "id string, project_id string, ssh_key_id string, is_active boolean, assigned_at timestamp, unassigned_at timestamp",
    "embedding_provider_configs": "id string, name string, provider string, endpoint_url string, model string, dimensions int, max_tokens int, settings_json string, credentials_encrypted binary, is_active boolean, is_default boolean, is_available_to_projects boolean, project_id string, created_at timestamp, updated_at timestamp",
    "llm_provider_configs": "id string, name string, provider string, endpoint_url string, model string, settings_json string, credentials_encrypted binary, is_active boolean, is_default boolean, is_available_to_projects boolean, project_id string, created_at timestamp, updated_at timestamp",
    "embedding_versions": "id string, embedding_provider_config_id string, provider string, model string, dimensions int, version_label string, created_at timestamp",
    "index_snapshots": "id string, project_id string, branch string, embedding_version_id string, git_commit string, commit_id string, is_active boolean, status string, created_at timestamp, activated_at timestamp",
    "indexing_jobs": "id string, project_id string, index_snapshot_id string, job_type string, status string, files_processed int, chunks_upserted int, vectors_deleted int, error_details string, worker_id string, started_at timestamp, finished_at timestamp, created_at timestamp",
    "files": "id string, project_id string, index_snapshot_id string, file_path string, language string, file_hash string, size_bytes long, line_count int, file_content_id string, file_facts string, issues string, extractor_statuses string",
    "file_contents": "id string, project_id string, content_hash string, content string, size_bytes long, line_count int",
    "symbols": "id string, project_id string, index_snapshot_id string, file_id string, name string, qualified_name string, kind string, signature string, start_line int, end_line int, doc_text string, symbol_hash string, parent_symbol_id string, flags string, modifiers array<string>, return_type string, parameter_types array<string>",
    "code_chunks": "id string, project_id string, index_snapshot_id string, file_id string, symbol_id string, chunk_type string, chunk_hash string, content string, context_before string, context_after string, start_line int, end_line int, estimated_tokens int, owner_qualified_name string, owner_kind string, is_exported_context boolean, semantic_role string",
    "dependencies": "id string, project_id string, index_snapshot_id string, source_file_path string, target_file_path string, import_name string, import_type string, package_name string, package_version string",
    "exports": "id string, project_id string, index_snapshot_id string, file_id string, export_kind string, exported_name string, local_name string, symbol_id string, source_module string, line int",
    "symbol_references": "id string, project_id string, index_snapshot_id string, file_id string, source_symbol_id string, reference_kind string, raw_text string, target_name string, qualified_target_hint string, start_line int, start_column int, end_line int, end_column int, resolution_scope string, resolved_target_symbol_id string, confidence string",
    "jsx_usages": "id string, project_id string, index_snapshot_id string, file_id string, source_symbol_id string, component_name string, is_intrinsic boolean, is_fragment boolean, line int, resolved_target_symbol_id string, confidence string",
    "network_calls": "id string, project_id string, index_snapshot_id string, file_id string, source_symbol_id string, client_kind string, method string, url_literal string, url_template string, is_relative boolean, start_line int, start_column int, confidence string",
    "api_keys": "id string, key_type string, key_prefix string, key_hash string, name string, role string, project_id string, is_active boolean, expires_at timestamp, last_used_at timestamp, created_by string, created_at timestamp",
    "query_log": "id string, project_id string, api_key_id string, user_id string, tool_name string, query_text string, result_count int, latency_ms int, created_at timestamp",
    "sessions": "id string, user_id string, token_hash string, ip_address string, user_agent string, expires_at timestamp, created_at timestamp",
    "commits": "id string, project_id string, commit_hash string, author_name string, author_email string, author_date timestamp, committer_name string, committer_email string, committer_date timestamp, message string",
    "commit_parents": "project_id string, commit_id string, parent_commit_id string, ordinal int",
    "commit_file_diffs": "id string, project_id string, commit_id string, parent_commit_id string, old_file_path string, new_file_path string, change_type string, patch string, additions int, deletions int",
    "vectors": "id string, project_id string, index_snapshot_id string, file_path string, language string, chunk_type string, symbol_type string, start_line int, end_line int, embedding array<float>",
}
#: Tables whose rows belong to one snapshot; they lie in a directory a project and snapshot, so reads prune to it.
BY_SNAPSHOT = ("files", "symbols", "code_chunks", "dependencies", "exports", "symbol_references", "jsx_usages", "network_calls", "vectors")


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
