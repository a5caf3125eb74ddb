"""Vector queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import scratch, vectors
from codelode.operators.text_index import TextIndex, fuse
from codelode.operators.vector_index import VectorIndex
from codelode.operators.vector_store import VectorStore
from codelode.plans.registry import query

_TOP = "SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q"


def _query(t):
    return t("embeddings").where("vec_id = 7").first()["embedding"]


@query(f"{_TOP} ORDER BY score DESC, e.vec_id LIMIT 10")
def vector_topk(t):
    return vectors.top_k(t("embeddings"), _query(t), 10).select("vec_id", "label", "score")


@query(f"{_TOP} WHERE e.label IN (2, 3) AND e.vec_id % 2 = 0 ORDER BY score DESC, e.vec_id LIMIT 10")
def vector_topk_filtered(t):
    return vectors.top_k(t("embeddings"), _query(t), 10, where=F.col("label").isin(2, 3) & (F.col("vec_id") % 2 == 0)).select("vec_id", "label", "score")


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q QUALIFY rank <= 10""")
def vector_topk_batch(t):
    queries = t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k_batch(t("embeddings"), queries, 10)


@query("SELECT count(*) AS wrong FROM embeddings WHERE len(embedding) <> 64")
def vector_dims_check(t):
    return vectors.wrong_dims(t("embeddings"), 64).agg(F.count("*").alias("wrong"))


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (3, 5, 8, 400000)")
def vector_get_by_ids(t):
    ids = t("embeddings").sparkSession.createDataFrame([(i,) for i in (3, 5, 8, 400_000)], "vec_id long")
    return t("embeddings").join(ids, "vec_id", "left_semi").select("vec_id")


@query("SELECT 1000000 + vec_id AS vec_id, 99 AS label, len(embedding) AS dims FROM embeddings WHERE vec_id % 3 = 0")
def vector_copy_forward(t):
    ids = t("embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("old_id"), (F.col("vec_id") + 1_000_000).alias("new_id"))
    return vectors.copy_forward(t("embeddings"), ids, label=F.lit(99)).select("vec_id", "label", F.size("embedding").alias("dims"))


@query()
def embed_documents(t):
    return vectors.embed(t("documents").select("doc_id", "text"), "text").select("doc_id", "embedding")


def _asked(t):
    return t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _indexed(t):
    return VectorIndex.build(t("embeddings"), scratch.folder(t("embeddings").sparkSession))


@query()
def vector_index_search(t):
    return _indexed(t).search(_asked(t), 10)


@query("SELECT count(*) AS queries, true AS recalled, true AS few_compared FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(t):
    """Whether the index finds 0.95 of the ten nearest, comparing fewer than a fifth of the vectors with a query."""
    index, total = _indexed(t), t("embeddings").count()
    near = vectors.top_k_batch(t("embeddings"), _asked(t), 10)
    found = near.join(index.search(_asked(t), 10).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.95 * F.count("*")).alias("recalled"))
    most = index.candidates(_asked(t), index.refine(10)).groupBy("query_id").count().agg((F.max("count") < total / 5).alias("few_compared"))
    return found.join(most)  # a row each


@query("""SELECT vec_id, CASE WHEN label IN (2, 5) THEN label + 100 ELSE label END AS label, CASE WHEN label IN (2, 5) THEN embedding[64] ELSE embedding[1] END::DOUBLE AS first FROM embeddings
UNION ALL SELECT vec_id + 10000000, label, embedding[1]::DOUBLE FROM embeddings WHERE label = 7""")
def vector_upsert(t):
    rows = t("embeddings").select("vec_id", "embedding", "label")
    store = VectorStore.create(rows.sparkSession, scratch.folder(rows.sparkSession), "vec_id long, embedding array<float>, label int", 64, buckets=16, key="vec_id")
    store.upsert(rows, "all")
    changed = rows.where("label IN (2, 5)").withColumns({"embedding": F.reverse("embedding"), "label": F.col("label") + 100, "at": F.lit(2)})
    late = changed.withColumns({"label": F.lit(-1), "at": F.lit(1)})
    new = rows.where("label = 7").withColumns({"vec_id": F.col("vec_id") + 10_000_000, "at": F.lit(1)})
    store.upsert(changed.unionByName(late).unionByName(new), "some", order="at")
    return store.table().select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first"))


_TERMS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
_BM25 = f"""d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS times, any_value(length) AS length FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS documents FROM p GROUP BY term), q AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - documents + 0.5) / (documents + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id),
text_rank AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _passages(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def _text_index(t):
    return TextIndex.build(t("documents"), scratch.folder(t("documents").sparkSession))


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM text_rank WHERE rank <= 10")
def text_search_bm25(t):
    return _text_index(t).search(_passages(t), 10)


@query(f"""WITH {_BM25}, v AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
vector_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM text_rank WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank FROM vector_rank WHERE rank <= 50) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_search(t):
    """Documents by the words of each benchmark item and by the vector of its number, fused; the vector of a document has its id."""
    of_items = t("embeddings").join(t("benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    by_vector = vectors.top_k_batch(t("embeddings").withColumnRenamed("vec_id", "doc_id"), of_items, 50, key="doc_id")
    return fuse([_text_index(t).search(_passages(t), 50), by_vector], "doc_id", 10)
