"""Text, chunk and parse queries. documents and pages are files; their text is parsed as what their paths say."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.parse import engine
from codelode.parse.languages import BASENAMES, BY_EXTENSION, detect_column
from codelode.plans.registry import query


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace('\ufeff' || replace(text, '. ', chr(13) || chr(10)) || chr(13), '^\ufeff', ''), '\\r\\n?', chr(10), 'g')) AS digest FROM documents")
def normalize_newlines(t):
    dirty = F.concat(F.lit("\ufeff"), F.replace(F.col("text"), F.lit(". "), F.lit("\r\n")), F.lit("\r"))
    return t("documents").select("doc_id", F.sha2(T.normalize_newlines(dirty), 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS lines FROM documents")
def count_lines(t):
    return t("documents").select("doc_id", T.count_lines(F.col("text")).alias("lines"))


@query("SELECT doc_id, coalesce(array_to_string(string_split(regexp_replace(text, '\\n$', ''), chr(10))[2:4], chr(10)), '') AS part FROM documents")
def line_range(t):
    return t("documents").select("doc_id", T.line_range(F.col("text"), 2, 4).alias("part"))


@query("SELECT doc_id, (strlen(text) + 3) // 4 AS tokens FROM documents")
def estimate_tokens(t):
    return t("documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(text) AS file_hash, 'sym_' || substr(sha256(source || ':' || lang || ':' || doc_id), 1, 16) AS symbol_id, substr(sha256(text), 1, 7) AS short FROM documents")
def sha_ids(t):
    return t("documents").select("doc_id", T.sha256(F.col("text")).alias("file_hash"), T.stable_id("sym", F.col("source"), F.col("lang"), F.col("doc_id")).alias("symbol_id"), T.short_hash(T.sha256(F.col("text"))).alias("short"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("SELECT conv_id, turn, substr(string_split(text, chr(10))[1], 1, 40) AS subject FROM conversations")
def message_subject(t):
    return t("conversations").select("conv_id", "turn", F.substring(T.subject(F.col("text")), 1, 40).alias("subject"))


@query("SELECT page_id, url NOT LIKE '%://%' AND NOT starts_with(url, '//') AS relative, starts_with(regexp_replace(url, '^https?:', ''), '/a') AS after FROM pages")
def relative_urls(t):
    return t("pages").select("page_id", T.is_relative_url(F.col("url")).alias("relative"), F.startswith(F.regexp_replace("url", "^https?:", ""), F.lit("/a")).alias("after"))


@query("SELECT vec_id, replace('open/ai' || '-m' || label || '-' || len(embedding), '/', '-') AS label_text, 'project_' || label || '__emb_' || replace('open/ai' || '-m' || label || '-' || len(embedding), '/', '-') AS collection FROM embeddings")
def version_labels(t):
    label = T.version_label(F.lit("open/ai"), F.concat(F.lit("m"), F.col("label")), F.size("embedding"))
    return t("embeddings").select("vec_id", label.alias("label_text"), T.collection_name(F.col("label"), label).alias("collection"))


_PATHS = "SELECT doc_id, source || '/d' || (doc_id % 9) || '/' || CASE WHEN doc_id % 13 = 0 THEN 'Dockerfile' WHEN doc_id % 13 = 1 THEN 'Makefile' ELSE 'file' || doc_id || (['.ts', '.py', '.go', '.TF', '.md', '.rs', '.unknown', '.tsx', '.java', '.d.ts'])[(doc_id % 10 + 1)::INT] END AS path FROM documents"


def _paths(t):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".py", ".go", ".TF", ".md", ".rs", ".unknown", ".tsx", ".java", ".d.ts")]), (F.col("doc_id") % 10 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 13 == 0, "Dockerfile").when(F.col("doc_id") % 13 == 1, "Makefile").otherwise(F.concat(F.lit("file"), F.col("doc_id"), ext))
    return t("documents").select("doc_id", F.concat(F.col("source"), F.lit("/d"), F.col("doc_id") % 9, F.lit("/"), name).alias("path"))


_CASE = "CASE " + " ".join(f"WHEN name = '{k}' THEN '{v}'" for k, v in BASENAMES.items()) + " " + " ".join(f"WHEN ext = '{k}' THEN '{v}'" for k, v in BY_EXTENSION.items()) + " END"


@query(f"SELECT doc_id, path, {_CASE} AS language FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '\\.[^./]*$')) AS ext FROM ({_PATHS}))")
def detect_language(t):
    return _paths(t).select("doc_id", "path", detect_column(F.col("path")).alias("language"))


@query("""SELECT doc_id AS key, 0 AS seq, text AS content, sha256(text) AS chunk_hash, 1 AS start_line,
CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS end_line FROM documents WHERE strlen(text) <= 7500""")
def raw_chunks_small(t):
    return engine.raw_chunks(t("documents").where(F.octet_length("text") <= 7500), "doc_id", "text")


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS bytes FROM documents")
def raw_chunks_rejoined(t):
    parts = engine.raw_chunks(t("documents"), "doc_id", "text")
    joined = parts.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "").alias("text"))  # the pieces of one file
    return joined.select(F.col("key").alias("doc_id"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query()
def raw_chunks(t):
    return engine.raw_chunks(t("documents"), "doc_id", "text")


def _pages(t):
    return t("pages").select(F.concat(F.lit("site/p"), "page_id", F.lit(".html")).alias("file_path"), F.col("html").alias("content"))


@query("SELECT 'site/p' || page_id || '.html' AS file, sha256(regexp_replace(html, '\\r\\n?', chr(10), 'g')) AS chunk_hash, 'module_context' AS chunk_type, 1 AS start_line FROM pages WHERE html <> ''")
def page_chunks(t):
    return engine.extract(_pages(t), "chunks").select("file", "chunk_hash", "chunk_type", "start_line")


@query("SELECT 'site/p' || page_id || '.html' AS file_path, 'html' AS language, sha256(html) AS file_hash, strlen(html) AS size_bytes FROM pages")
def file_meta(t):
    return engine.parse(_pages(t)).select("file_path", "language", "file_hash", "size_bytes")


#: A source file made of a document's words, so that parsing has something to find.
def _code(t):
    w = F.split(F.regexp_replace(F.lower("text"), "[^a-z ]+", " "), " +", 8)  # words 0 to 6, and the rest as one
    word = lambda i: F.concat(F.lit("n"), F.coalesce(F.get(w, F.lit(i)), F.lit("x")))
    body = F.concat(
        F.lit("import os\nfrom . import util\nfrom ..models import "), word(1), F.lit("\nimport requests\n\n\ndef "), word(2), F.lit("(a):\n    # "), word(3), F.lit("\n    return requests.get('/api/"), word(4), F.lit("')\n\n\nclass C"), word(5),
        F.lit(":\n    def _"), word(6), F.lit("(self):\n        return "), word(2), F.lit("(self)\n"),
    )
    return t("documents").select("doc_id", F.concat(F.lit("pkg/sub/m"), "doc_id", F.lit(".py")).alias("file_path"), body.alias("content"), *[word(i).alias(f"w{i}") for i in range(1, 7)])


_WORD = "'n' || coalesce(w[{i}], 'x')"
_CODE = "SELECT doc_id, 'pkg/sub/m' || doc_id || '.py' AS file, " + ", ".join(f"{_WORD.format(i=i + 1)} AS w{i}" for i in range(1, 7)) + " FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g'), ' +') AS w FROM documents)"


@query(f"""SELECT file, import_name, import_type, target_file_path FROM ({_CODE}), (VALUES ('os', 'STDLIB', ''), ('.util', 'INTERNAL', 'pkg/sub/util'), ('..models', 'INTERNAL', 'pkg/models'), ('requests', 'EXTERNAL', '')) v(import_name, import_type, target_file_path)""")
def import_extract(t):
    return engine.extract(_code(t), "imports").select("file", "import_name", "import_type", "target_file_path")


@query(f"SELECT file, w2 AS name, 'function' AS kind, 7 AS start_line, 9 AS end_line FROM ({_CODE}) UNION ALL SELECT file, 'C' || w5, 'class', 12, 14 FROM ({_CODE}) UNION ALL SELECT file, '_' || w6, 'method', 13, 14 FROM ({_CODE})")
def symbol_extract(t):
    return engine.extract(_code(t), "symbols").select("file", "name", "kind", "start_line", "end_line")


@query(f"SELECT file, w2 AS exported_name, 'NAMED' AS export_kind, 7 AS line FROM ({_CODE}) UNION ALL SELECT file, 'C' || w5, 'NAMED', 12 FROM ({_CODE})")
def export_extract(t):
    return engine.extract(_code(t), "exports").select("file", "exported_name", "export_kind", "line")


@query(f"SELECT file, 'GET' AS method, '/api/' || w4 AS url_literal, true AS is_relative, 'HIGH' AS confidence FROM ({_CODE})")
def network_calls(t):
    return engine.extract(_code(t), "network_calls").select("file", "method", "url_literal", "is_relative", "confidence")


@query(f"SELECT file, w2 AS target_name, 'LOCAL' AS resolution_scope, 'HIGH' AS confidence FROM ({_CODE})")
def scope_confidence(t):
    refs = engine.extract(_code(t), "references").where("reference_kind = 'CALL' AND qualified_target_hint = ''")
    return refs.select("file", "target_name", "resolution_scope", "confidence")


@query(f"SELECT file AS file_path, true AS has_class_declarations, true AS has_fetch_calls, true AS has_named_exports, false AS has_tests, false AS has_jsx FROM ({_CODE})")
def file_facts(t):
    return engine.parse(_code(t)).select("file_path", *[F.col(f"facts.{c}").alias(c) for c in ("has_class_declarations", "has_fetch_calls", "has_named_exports", "has_tests", "has_jsx")])


@query(f"SELECT file, 'function' AS chunk_type, 7 AS start_line, 9 AS end_line, 'api_surface' AS semantic_role FROM ({_CODE}) UNION ALL SELECT file, 'class', 12, 14, 'api_surface' FROM ({_CODE}) UNION ALL SELECT file, 'module_context', 1, 6, 'implementation' FROM ({_CODE})")
def symbol_chunks(t):
    return engine.extract(_code(t), "chunks").select("file", "chunk_type", "start_line", "end_line", "semantic_role")


@query("""WITH l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) = count(DISTINCT turn))),
s AS (SELECT conv_id, n, total, lead(n) OVER (PARTITION BY conv_id ORDER BY n) AS nxt FROM l WHERE turn % 2 = 0) SELECT conv_id, n AS start_line, coalesce(nxt - 1, total) AS end_line FROM s""")
def test_block_chunks(t):
    from pyspark.sql import Window

    rows = t("conversations").select("conv_id", "turn")
    good = rows.groupBy("conv_id").agg(F.count("*").alias("a"), F.count_distinct("turn").alias("b")).where("a = b").select("conv_id", F.col("a").alias("total"))
    by = Window.partitionBy("conv_id").orderBy("turn")
    lines = rows.join(good, "conv_id").withColumn("n", F.row_number().over(by)).where("turn % 2 = 0")
    return lines.select("conv_id", F.col("n").alias("start_line"), F.coalesce(F.lead("n").over(by) - 1, F.col("total")).alias("end_line"))


@query("""WITH e AS (SELECT user_id, event_id, hour(ts) AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error'),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, line ORDER BY n) AS island FROM e)
SELECT user_id AS file_id, line, min(n) AS first, count(*) AS errors FROM g GROUP BY user_id, line, island""")
def issue_merge_same_line(t):
    from pyspark.sql import Window

    e = t("events").where("event_type = 'error'").select("user_id", "event_id", F.hour("ts").cast("long").alias("line"))
    by = Window.partitionBy("user_id").orderBy("event_id")
    marked = e.withColumn("n", F.row_number().over(by)).withColumn("new", F.when(F.col("line") == F.lag("line").over(by), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    return marked.groupBy("user_id", "line", "run").agg(F.min("n").alias("first"), F.count("*").alias("errors")).select(F.col("user_id").alias("file_id"), "line", "first", "errors")
