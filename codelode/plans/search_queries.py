"""Content, symbol and commit search. documents are files, part is symbols, orders is commits, pages.url is a path."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import predicates as P
from codelode.operators.search import search_commits, search_content, search_symbols
from codelode.plans.registry import query

_MATCH = "(length(lower({c})) - length(replace(lower({c}), '{q}', ''))) // {n}"


@query(f"SELECT doc_id, lang, source, {_MATCH.format(c='text', q='tion of', n=7)} AS match_count FROM documents WHERE text ILIKE '%tion of%' ORDER BY doc_id LIMIT 20")
def search_insensitive(t):
    return search_content(t("documents"), "Tion OF").page().select("doc_id", "lang", "source", "match_count")


@query("SELECT doc_id, (length(text) - length(replace(text, 'The', ''))) // 3 AS match_count FROM documents WHERE text LIKE '%The%'")
def search_sensitive(t):
    return search_content(t("documents"), "The", "sensitive").rows.select("doc_id", "match_count")


@query("SELECT doc_id, len(regexp_extract_all(text, '[a-z]+tion of')) AS match_count FROM documents WHERE regexp_matches(text, '[a-z]+tion of')")
def search_regex(t):
    return search_content(t("documents"), "[a-z]+tion of", "regex").rows.select("doc_id", "match_count")


@query(r"SELECT doc_id, (length(text) - length(replace(text, '%%%', ''))) // 3 AS match_count FROM documents WHERE text LIKE '%\%\%\%%' ESCAPE '\'")
def search_escape_like(t):
    return search_content(t("documents"), "%%%").rows.select("doc_id", "match_count")


@query(f"SELECT doc_id, {_MATCH.format(c='text', q='keit', n=4)} AS match_count FROM documents WHERE lang = 'de' AND text ILIKE '%keit%' ORDER BY doc_id LIMIT 100 OFFSET 20")
def search_lang_filter(t):
    return search_content(t("documents"), "KEIT", language=("lang", "de")).page(500, 20).select("doc_id", "match_count")


@query("SELECT count(*) AS total FROM documents WHERE text ILIKE '%the and%'")
def search_count(t):
    return search_content(t("documents"), "the and").total()


@query(f"SELECT source, lang, sum({_MATCH.format(c='text', q='on', n=2)})::BIGINT AS matches, count(*) AS files FROM documents WHERE text ILIKE '%on%' GROUP BY source, lang")
def search_match_count(t):
    return search_content(t("documents"), "on").rows.groupBy("source", "lang").agg(F.sum("match_count").alias("matches"), F.count("*").alias("files"))


@query("SELECT page_id, url, (length(html) - length(replace(html, '<p>', ''))) // 3 AS match_count FROM pages WHERE html LIKE '%<p>%' AND regexp_matches(url, '[^/]*/en/[^/]*$') AND NOT regexp_matches(url, '(^|/)#top$') ORDER BY url, page_id LIMIT 30")
def search_file_pattern(t):
    found = search_content(t("pages"), "<p>", "sensitive", content="html", key="page_id", path="url", file_pattern="*/en/*", exclude="**#top")
    return found.page(30).select("page_id", "url", "match_count")


def _symbols(t):
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"))


_SYM = "SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS file_path, p_size AS start_line FROM part"


@query(f"{_SYM} ORDER BY file_path, start_line, id LIMIT 50")
def symbol_list_default(t):
    return search_symbols(_symbols(t)).page(default=50, most=200)


@query(f"{_SYM} WHERE name ILIKE '%RED WIDGET%' ORDER BY CASE WHEN lower(name) = lower('RED WIDGET') THEN 0 ELSE 1 END, name, id LIMIT 200")
def symbol_list_exact_first_ci(t):
    return search_symbols(_symbols(t), "RED WIDGET").page(1000, default=50, most=200)


@query(f"{_SYM} WHERE name LIKE '%blue bolt%' ORDER BY CASE WHEN name = 'blue bolt' THEN 0 ELSE 1 END, name, id LIMIT 50")
def symbol_list_exact_first_cs(t):
    return search_symbols(_symbols(t), "blue bolt", "sensitive").page(default=50, most=200)


@query(f"{_SYM} WHERE regexp_matches(name, '^(red|small) [a-r]') ORDER BY name, id LIMIT 50 OFFSET 10")
def symbol_list_regex(t):
    return search_symbols(_symbols(t), "^(red|small) [a-r]", "regex").page(None, 10, default=50, most=200)


@query(f"{_SYM} WHERE name ILIKE '%b_lt%' ORDER BY CASE WHEN lower(name) = 'b_lt' THEN 0 ELSE 1 END, name, id LIMIT 200")
def symbol_list_wildcards(t):
    return search_symbols(_symbols(t), "b_lt").page(200, default=50, most=200)


@query("SELECT count(*) AS total FROM part WHERE p_type = 'PROMO' AND p_name ILIKE '%ring%'")
def symbol_kind_filter(t):
    return search_symbols(_symbols(t), "ring", kind=("kind", "PROMO")).total()


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(^|/)en/.*')")
def glob_include(t):
    return t("pages").where(P.path_allowed(F.col("url"), ["**/en/**"])).select("page_id", "url")


@query(r"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '[^/]*\.example\.com/.*') AND NOT regexp_matches(url, '^http:/')")
def glob_exclude(t):
    return t("pages").where(P.path_allowed(F.col("url"), [], ["*.example.com/**", "http:"])).select("page_id", "url")


@query(r"SELECT page_id FROM pages WHERE (regexp_matches(url, '^https:/.*[^/]*/en/[^/]*$') OR regexp_matches(url, '^http://m\..*')) AND NOT regexp_matches(url, '[^/]*#top$')")
def glob_multi(t):
    return t("pages").where(P.path_allowed(F.col("url"), P.path_patterns("https:/**/*/en/*, http://m.**"), ["*#top"])).select("page_id")


def _commits(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("message"), F.col("o_orderdate").alias("committer_date"), F.col("o_totalprice").alias("size"))


_COMMIT = "SELECT o_orderkey AS id, o_custkey AS project_id, o_orderpriority AS message, o_orderdate AS committer_date FROM orders"


@query(f"{_COMMIT} WHERE message ILIKE '%urgent%' AND committer_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' ORDER BY committer_date DESC NULLS LAST, id DESC LIMIT 20")
def commit_list_filtered(t):
    return search_commits(_commits(t), "urgent", since="1996-01-01", until="1997-12-31").page().drop("size")


@query("SELECT count(*) AS total FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-03-31'")
def commit_range(t):
    return search_commits(_commits(t), since="1998-03-01", until="1998-03-31").total()


@query("SELECT c_custkey AS author_id, c_name AS author, count(*) AS commits, max(o_orderdate) AS last_commit FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def commit_summary(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author")).agg(F.count("*").alias("commits"), F.max("o_orderdate").alias("last_commit"))
