"""Shards that all have the mixture of the corpus: proportional interleaving of its sources.

Rows of a source are put in a seeded random order; the one at place r of n gets the fraction (r + u) / n, with u in [0, 1) of the
source. Sorted by fraction, each source's rows lie evenly among all, and cutting that order into equal runs gives each shard every
source in proportion. u keeps small sources from meeting in the middle.

Places come from two sorts by range (within sources, then by fraction), in which a task numbers its own rows and a table of a row a
task (and source) says where it starts: no window over a whole source, so a source with a third of all rows is dealt like any other.
Only ids, sizes and checksums are sorted; texts stay where they are until shards are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm._common import parts, written

SHARDS, SEED, ROWS_EACH = 8, 12, 1 << 20
_U_BITS = 20


def _numbered(rows: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """rows in order, with part (the task) and place (from 0, within the part and, if given, its rows of one group)."""
    n = max(parts(rows.count(), ROWS_EACH), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            at = np.arange(len(batch), dtype=np.int64)
            if group is None:
                place = at + seen
                seen += len(batch)
            else:
                own = batch.column(group)
                new = np.concatenate([[own[0].as_py() != last], own.slice(1).to_numpy(zero_copy_only=False) != own.slice(0, len(own) - 1).to_numpy(zero_copy_only=False)])
                start = np.maximum.accumulate(np.where(new, at, -1))
                place = np.where(start < 0, at + seen, at - start)
                last, seen = own[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(f, f"{fields}, part int, place long"))


def _whole_places(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows with place counted over all parts, and total, the rows there are (of the group)."""
    count = rows.groupBy("part", *group).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*group)
    before = F.sum("n").over(own.orderBy("part")) - F.col("n")
    return rows.join(count.select("part", *group, before.alias("before"), F.sum("n").over(own).alias("total")), ["part", *group]).withColumn("place", F.col("before") + F.col("place")).drop("before", "part")


def interleave(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows (stratum string, order_key string, tie long, all without nulls, and more) with shard and slot in place of stratum.

    Strata are shuffled by order_key, tie; both decide where fractions are equal too. Shards differ by one row at most, slots have no gap.
    """
    kept = [c for c in rows.columns if c not in ("stratum", "order_key", "tie")]
    order = ["order_key", "tie"]
    ranked = _whole_places(_numbered(rows, ["stratum", *order], "stratum"), ["stratum"])
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "stratum")), 1, _U_BITS // 4), 16, 10).cast("double") / (1 << _U_BITS)
    mixed = _numbered(ranked.withColumn("fraction", (F.col("place") + u) / F.col("total")).drop("place", "total"), ["fraction", "stratum", *order])
    placed = _whole_places(mixed, [])
    shard = F.expr(f"place * {shards} div total")
    return placed.select(*kept, shard.cast("int").alias("shard"), (F.col("place") - F.expr(f"((place * {shards} div total) * total + {shards - 1}) div {shards}")).alias("slot"))


def _keys(row: Column, source_col: str, id_col: str, text_col: str, seed: int) -> list[Column]:
    source, doc, text = F.col(source_col).cast("string"), F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    crc = F.crc32(text)
    return [
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("stratum"), F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))), F.lpad(crc.cast("string"), 10, "0")).alias("order_key"), row.alias("tie"),
        doc.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), crc.alias("text_crc32"),
    ]


def place(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 1), text_crc32, shard and slot of every row.

    Which shard depends on ids, sources and checksums, not on the layout of the input. Defined cases: a null text is an empty one; rows
    without source are a source of their own; rows without id, or that repeat one, each have a slot (of rows equal in all of source, id
    and text any may be first); an empty table gives an empty result; extra columns are ignored.
    """
    rows = written(docs.select(*_keys(F.monotonically_increasing_id(), source_col, id_col, text_col, seed)))
    return interleave(rows, shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
    """The rows of docs as Parquet below path, a directory a shard and in it ranges of slots in order; see place for defined cases.

    docs get two columns more, shard and slot (theirs of these names are replaced). Texts are written once aside with row numbers and
    shuffled once.
    """
    row = "__row"
    whole = written(docs.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()))
    keys = _keys(F.col(row), source_col, id_col, text_col, seed)
    placed = interleave(written(whole.select(*keys, F.col(row))), shards, seed).select(row, "shard", "slot")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole.join(placed, row).drop(row).repartitionByRange(max(n, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sharded(docs: DataFrame) -> DataFrame:
    """place() in the columns of the query: with law and grown_shard (null, as shards hold rows in equal number)."""
    return place(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
