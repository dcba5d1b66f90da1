"""A stored index of prints: written in buckets, refreshed by content, probed without reading more buckets than a probe asks for."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import fingerprints as fp
from sparkloom.sources import stores

#: Buckets of prints and of documents; a bucket is a folder.
BUCKETS = 64


class PrintIndex:
    """Anchors of documents in buckets of their hash, and the documents' words in buckets of their id, both sorted.

    `put` takes documents in place of older ones of their ids; one whose words are the same as before is left alone, and only buckets of changed documents are
    written. `drop` takes ids that were seen before and are gone. Ids are not null and whole numbers; a document of fewer than k words has no prints, but is known.
    """

    def __init__(self, spark: SparkSession, path: str, k: int, w: int, buckets: int = BUCKETS):
        self.spark, self.path, self.k, self.w, self.buckets = spark, path, k, w, buckets

    def _read(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{kind}")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _replace(self, kind: str, key: str, gone: DataFrame, new: DataFrame) -> None:
        """Rewrite the buckets that `gone` (doc, bucket) or `new` touch: rows of `gone` leave, `new` come."""
        old, fresh = self._read(kind), new.withColumn("bucket", self._bucket(key))
        if old is not None:
            touched = gone.select("bucket").union(fresh.select("bucket")).distinct()
            stay = old.join(touched, "bucket", "left_semi").join(gone.select("doc").distinct(), "doc", "left_anti")
            # a bucket that nothing stays in is overwritten by no rows, so it keeps one row without a document
            empty = touched.select(*(F.col("bucket") if c == "bucket" else F.lit(None).cast(t).alias(c) for c, t in fresh.dtypes))
            fresh = fresh.unionByName(stay.select(fresh.columns)).unionByName(empty)
        step = stores.written(fresh.repartition("bucket").sortWithinPartitions("bucket", key), f"index-{kind}")
        stores.overwrite_partitions(step, f"{self.path}/{kind}", "bucket")
        stores.drop(step)

    def documents(self) -> DataFrame | None:
        """(doc, t, same, bucket) of every document known."""
        found = self._read("documents")
        return None if found is None else found.where("doc is not null")

    def put(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> int:
        """The number of documents that were new or changed."""
        stream = fp.streams(docs.where(F.col(id_column).isNotNull()), self.k, self.w, id_column, text).select("doc", "t", "anchors", "same")
        known = self.documents()
        if known is not None:
            was = known.select(F.col("doc").alias("k"), F.col("same").alias("was"))
            stream = stream.join(was, (F.col("doc") == F.col("k")) & (F.col("same") == F.col("was")), "left_anti")
        changed = stores.written(stream, "index-changed")
        n = changed.count()
        if n:
            self._swap(changed.select("doc"), changed)
        stores.drop(changed)
        return n

    def drop(self, ids: DataFrame, id_column: str = "doc_id") -> None:
        known = self.documents()
        if known is not None:
            gone = known.select("doc").join(ids.select(F.col(id_column).alias("doc")).distinct(), "doc", "left_semi")
            none = self.spark.createDataFrame([], "doc bigint, t array<bigint>, anchors array<struct<p:bigint,g:bigint>>, same binary")
            self._swap(gone, none)

    def _swap(self, gone: DataFrame, new: DataFrame) -> None:
        gone = stores.written(gone.withColumn("bucket", self._bucket("doc")), "index-gone")
        prints = self._read("prints")
        held = gone.select("doc", "bucket").where("false") if prints is None else prints.select("doc", "bucket").join(gone.select("doc"), "doc", "left_semi").distinct()
        held = stores.written(held, "index-held")
        self._replace("prints", "g", held, fp.anchors(new).select("doc", "p", "g"))
        self._replace("documents", "doc", gone, new.select("doc", "t", "same"))
        stores.drop(held)
        stores.drop(gone)

    def scan(self, hashes: DataFrame) -> DataFrame:
        """Prints (doc, p, g) with one of the hashes (g): only their buckets are listed and read; at most `buckets` numbers go through the driver."""
        wanted = sorted(r[0] for r in hashes.select(self._bucket("g").alias("b")).distinct().collect())
        prints = self._read("prints")
        if prints is None:
            return self.spark.createDataFrame([], "doc bigint, p bigint, g bigint")
        return prints.where(F.col("bucket").isin(wanted) & F.col("doc").isNotNull()).join(hashes.select("g").distinct(), "g", "left_semi").select("doc", "p", "g")

    def probe(self, probes: DataFrame, id_column: str, text: str = "text", itself: bool = False) -> DataFrame:
        """(a, b, pa, pb, tokens, n_distinct): maximal runs of a probe (a) in stored documents (b). `itself`: ids are those of the index, and a document is not
        held against its own older self. Each run of k + w - 1 words or more is found."""
        asked = stores.written(fp.streams(probes.where(F.col(id_column).isNotNull()), self.k, self.w, id_column, text), "probe")
        mine, documents = fp.anchors(asked), self.documents()
        if documents is None:
            return self.spark.createDataFrame([], fp._RUN_FIELDS)
        there = self.scan(mine)
        hits = mine.select(F.col("doc").alias("a"), F.col("p").alias("pa"), "g").join(there.select(F.col("doc").alias("b"), F.col("p").alias("pb"), "g"), "g")
        if itself:
            hits = hits.where("a <> b")
        pairs = stores.written(
            hits.groupBy("a", "b").agg(F.collect_list(F.struct((F.col("pb") - F.col("pa")).alias("gap"), F.col("pa").alias("at"))).alias("seeds")), "probe-pairs"
        )
        # the words of documents that are hit, from their buckets alone
        wanted = sorted(r[0] for r in pairs.select(self._bucket("b").alias("x")).distinct().collect())
        return fp.runs_of(pairs, asked.select("doc", "t"), documents.where(F.col("bucket").isin(wanted)).select("doc", "t"), self.k)
