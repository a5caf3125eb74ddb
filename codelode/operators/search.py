"""Content, symbol and commit search. Each search is one filtered frame, from which the page and the total both come."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import predicates as P


@dataclass
class Result:
    """A search: all matching rows, and the order that pages are cut in."""

    rows: DataFrame
    order: list[Column]

    def page(self, limit: int | None = None, offset: int | None = None, default: int = 20, most: int = 100) -> DataFrame:
        n, skip = P.page(limit, offset, default, most)
        ordered = self.rows.orderBy(*self.order)
        return (ordered.offset(skip) if skip else ordered).limit(n)

    def total(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("total"))


def search_content(files: DataFrame, query: str, mode: str = "insensitive", *, content: str = "text", key: str = "doc_id", path: str | None = None, language: tuple[str, str] | None = None, file_pattern: str | None = None, include: str | None = None, exclude: str | None = None) -> Result:
    """Rows whose content has the query, with match_count.

    language is (column, value). The content is read for the filter and the count only; equality filters come first, so they
    reach the scan.
    """
    if not query.strip():
        raise P.BadRequest("query must not be blank")
    if len(query) > P.MAX_QUERY:
        raise P.BadRequest(f"query exceeds maximum length of {P.MAX_QUERY}")
    rows = files
    if language:
        rows = rows.where(F.col(language[0]) == language[1])
    if path and (file_pattern or include or exclude):
        globs = P.path_patterns(include) + ([file_pattern] if file_pattern else [])
        rows = rows.where(P.path_allowed(F.col(path), globs, P.path_patterns(exclude, "exclude_dir")))
    rows = rows.where(P.text_matches(F.col(content), query, mode)).withColumn("match_count", P.match_count(F.col(content), query, mode))
    return Result(rows, ([F.col(path).asc_nulls_last()] if path else []) + [F.col(key)])


def search_symbols(symbols: DataFrame, name: str = "", mode: str = "insensitive", *, name_col: str = "name", kind: tuple[str, str] | None = None, path: str = "file_path", line: str = "start_line", key: str = "id", include: str | None = None, exclude: str | None = None) -> Result:
    """Symbols by name, kind and path. Exact names come first (not for patterns), then by name; without a name by place.

    % and _ in a name act as wildcards.
    """
    mode, rows, order = P.search_mode(mode), symbols, [F.col(path), F.col(line), F.col(key)]
    if kind:
        rows = rows.where(F.col(kind[0]) == kind[1])
    if include or exclude:
        rows = rows.where(P.path_allowed(F.col(path), P.path_patterns(include), P.path_patterns(exclude, "exclude_dir")))
    if name:
        c = F.col(name_col)
        rows, order = rows.where(P.text_matches(c, name, mode, literal=False)), [c, F.col(key)]
        if mode != "regex":
            same = F.lower(c) == F.lower(F.lit(name)) if mode == "insensitive" else c == name
            order.insert(0, F.when(same, 0).otherwise(1))
    return Result(rows, order)


def search_commits(commits: DataFrame, message: str = "", *, message_col: str = "message", date: str = "committer_date", key: str = "id", since: str | None = None, until: str | None = None) -> Result:
    """Commits by message (wildcards act) and date (both ends included), newest first."""
    rows = commits
    if since:
        rows = rows.where(F.col(date) >= F.lit(since).cast(rows.schema[date].dataType))
    if until:
        rows = rows.where(F.col(date) <= F.lit(until).cast(rows.schema[date].dataType))
    if message:
        rows = rows.where(P.text_matches(F.col(message_col), message, literal=False))
    return Result(rows, [F.col(date).desc_nulls_last(), F.col(key).desc()])
