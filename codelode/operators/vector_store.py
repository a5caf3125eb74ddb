"""A collection of vectors with payload that is changed by id: Parquet in buckets of an id hash.

A change rewrites the buckets that it touches, in one job, to a folder of its own; the files of other buckets stay as they are. A
manifest (a small file, one a version) says which folder has each bucket; writing it is the commit, so readers see a change whole or
not at all. A batch has an id: one that broke off is done again in place, one that was committed is not done twice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codelode.operators import scratch


class VectorStore:
    """Vectors below a folder (any URI that Spark reads). One writer at a time; readers may read meanwhile."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, columns: str, dims: int, buckets: int = 64, key: str = "id", vector: str = "embedding") -> VectorStore:
        """Make a collection of vectors of dims entries, if it is not there yet; columns (DDL) are its key, vector and payload.

        buckets should be so many that each holds some hundred MB in the end; their number cannot change.
        """
        store = cls(spark, root)
        meta = {"columns": columns, "dims": dims, "buckets": buckets, "key": key, "vector": vector}
        if not scratch.write_json(spark, f"{store.root}/collection.json", meta) and store._meta() != meta:
            raise ValueError(f"{root} holds another collection")
        return store

    def _meta(self) -> dict:
        return scratch.read_json(self.spark, f"{self.root}/collection.json")

    def _manifest(self) -> dict:
        versions = [n for n in scratch.names(self.spark, f"{self.root}/versions") if n.endswith(".json") and not n.startswith(".")]
        return scratch.read_json(self.spark, f"{self.root}/versions/{versions[-1]}") if versions else {"version": 0, "done": [], "buckets": {}}

    def _schema(self) -> StructType:
        return StructType.fromDDL(self._meta()["columns"])

    def _bucket(self, key: Column) -> Column:
        meta = self._meta()
        kind = StructType.fromDDL(meta["columns"])[meta["key"]].dataType
        return F.pmod(F.xxhash64(key.cast(kind)), F.lit(meta["buckets"])).cast("int")

    def _read(self, buckets: dict[str, str]) -> DataFrame:
        paths = [f"{self.root}/data/{folder}/bucket={b}" for b, folder in sorted(buckets.items())]
        return self.spark.read.schema(self._schema()).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema())

    def table(self) -> DataFrame:
        """All vectors as of now; a later change does not alter what this reads (until vacuum)."""
        return self._read(self._manifest()["buckets"])

    def get(self, ids: Iterable) -> DataFrame:
        """Vectors by id; only the buckets that may hold them are read. Ids should be a few thousand at most."""
        meta, ids = self._meta(), list(ids)
        kind = self._schema()[meta["key"]].dataType
        asked = self.spark.createDataFrame([(i,) for i in ids], StructType().add(meta["key"], kind))
        own = {str(r["b"]) for r in asked.select(self._bucket(F.col(meta["key"])).alias("b")).distinct().collect()}
        return self._read({b: f for b, f in self._manifest()["buckets"].items() if b in own}).where(F.col(meta["key"]).isin(ids))

    def upsert(self, rows: DataFrame, batch: str, order: str | None = None) -> int:
        """Put rows in by id, replacing vector and payload of those that are there; returns how many buckets were rewritten.

        Of rows with one id the one greatest in order wins (without order, any). A row without id, or with a vector that is null or has
        not dims entries, fails the batch before anything is written. batch names the change: run again, it is done once.
        """
        meta = self._meta()
        key, vector = F.col(meta["key"]), F.col(meta["vector"])
        bad = rows.where(key.isNull() | (F.coalesce(F.size(vector), F.lit(-1)) != meta["dims"])).select(key.cast("string").alias("k")).limit(5).collect()
        if bad:
            raise ValueError(f"no id, or not {meta['dims']} entries: {[r['k'] for r in bad]}")
        schema = self._schema()
        shaped = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        new = rows.select(F.struct(*shaped).alias("r"), (F.col(order) if order else F.lit(0)).alias("o")).groupBy(F.col(f"r.{meta['key']}").alias("k")).agg(F.max_by("r", "o").alias("r")).select("r.*")
        return self._change(new.select(self._bucket(key).alias("b")), batch, lambda have: have.join(new.select(meta["key"]), meta["key"], "left_anti").unionByName(new))

    def patch(self, ids: DataFrame, batch: str, **payload: Column) -> int:
        """Set payload columns of the vectors whose id is in ids (a column named as the key)."""
        key = self._meta()["key"]
        ids = ids.select(key).distinct().withColumn("__hit", F.lit(True))
        hit = F.col("__hit").isNotNull()
        return self._change(ids.select(self._bucket(F.col(key)).alias("b")), batch, lambda have: have.join(ids, key, "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in payload.items()}))

    def delete(self, where: Column, batch: str) -> int:
        """Take out the vectors for which a condition is true, such as those of a snapshot or a file."""
        gone = F.coalesce(where, F.lit(False))
        return self._change(self.table().where(gone).select(self._bucket(F.col(self._meta()["key"])).alias("b")), batch, lambda have: have.where(~gone))

    def _change(self, touched: DataFrame, batch: str, change) -> int:
        now = self._manifest()
        if batch in now["done"]:
            return 0
        own = [str(r["b"]) for r in touched.distinct().collect()]  # as many as there are buckets at most
        if not own:
            return 0
        folder = f"{batch}.{now['version']}"  # what was written before another batch was committed is of no use
        meta, at = self._meta(), f"{self.root}/data/{folder}"
        if not scratch.exists(self.spark, f"{at}/_SUCCESS"):
            rows = change(self._read({b: f for b, f in now["buckets"].items() if b in own})).select(*self._schema().names)
            rows = rows.withColumn("bucket", self._bucket(F.col(meta["key"]))).repartition(len(own), "bucket").sortWithinPartitions("bucket", meta["key"])
            rows.write.mode("overwrite").partitionBy("bucket").parquet(at)
        full = {n.removeprefix("bucket=") for n in scratch.names(self.spark, at) if n.startswith("bucket=")}
        buckets = {b: f for b, f in now["buckets"].items() if b not in own} | {b: folder for b in own if b in full}
        new = {"version": now["version"] + 1, "done": [*now["done"], batch][-1000:], "buckets": buckets}
        if not scratch.write_json(self.spark, f"{self.root}/versions/{new['version']:012d}.json", new):
            raise RuntimeError(f"{self.root} was changed by another writer meanwhile")
        return len(own)

    def vacuum(self) -> list[str]:
        """Remove the folders of buckets that the newest version does not name, which only readers that began before it need."""
        now, gone = self._manifest(), []
        for folder in scratch.names(self.spark, f"{self.root}/data"):
            for b in scratch.names(self.spark, f"{self.root}/data/{folder}"):
                if b.startswith("bucket=") and now["buckets"].get(b.removeprefix("bucket=")) != folder:
                    scratch.remove(self.spark, f"{self.root}/data/{folder}/{b}")
                    gone.append(f"{folder}/{b}")
        return gone
