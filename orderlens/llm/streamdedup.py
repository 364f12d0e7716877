"""Exact deduplication by a stateful stream.

Two structured streams run over a folder of documents. The first fingerprints every new row once: its
digest, its stable identifier (doc_id) and its content locator (file and row number). The second keeps one
state entry a digest, in RocksDB on disk and without expiry: how many rows have it, and the identifier and
locator of the row that stays so far, which is that with the largest doc_id. Partial aggregates combine the
copies of a task before they reach the state, so a text that a third of all rows share costs a row a task.
Both streams go on where they stopped: new files add to the same state.

A digest that several rows have is a hit, and hits are checked byte by byte: the content at the state's
locator is read again and compared with the content of every hit. Rows that differ from it (which for
SHA-256 nobody has seen, but shorter digests allow) are grouped by their full texts instead. Only texts that
may be hits move: a bitmap of hit digests of bounded size is broadcast to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlens.llm.store import Scratch
from orderlens.sources.fs import list_entries

FINGERPRINT = "doc_id long, digest binary, file string, pos long"
ENTRY = "digest binary, n long, last struct<doc_id: long, file: string, pos: long>"

#: A micro-batch reads a part of the input that is waiting, and not less than LEAST_BATCH bytes.
BATCHES, LEAST_BATCH = 64, 128 << 20
#: Bits of the broadcast bitmap for each hit digest, and its largest size (64 MB). Beyond that it lets more
#: rows through, which costs time and changes no result.
BITS_EACH, MOST_BITS = 16, 1 << 29
#: A digest that more than 1 / HOT of all rows have is hot: fewer than HOT digests are.
HOT = 1000

_STATE_CONFS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # state partitions are many and small: no file space ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _STATE_CONFS}
    for k, v in _STATE_CONFS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class StreamingDedup:
    """The deduplication state of one growing table of Parquet files at ``path`` (a folder or one file) with
    the columns doc_id (a whole number) and text. ``store`` is a folder on shared storage that holds the
    streams' checkpoints, the fingerprints and the state's changes; the same folder continues the same state.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest doc_id
    stays, of equal doc_ids (and where all are null) the last by file and row number, so exactly one row a
    group. Texts of any length are hashed and compared whole; repeated rows are copies of each other; an
    empty table gives no rows; other columns are ignored. Files must not change once they are read.
    """

    def __init__(self, spark: SparkSession, path: str, store: str, digest: Callable[[Column], Column] = sha256,
                 files_per_batch: int | None = None):
        self.spark, self.path, self.store, self.digest, self.files_per_batch = spark, path.rstrip("/"), store.rstrip("/"), digest, files_per_batch

    # -- input -------------------------------------------------------------------------------------

    def _located(self, df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        text = F.coalesce(df["text"], F.lit(""))
        return df.select(df["doc_id"].cast("long").alias("doc_id"), self.digest(text).alias("digest"),
                         at["file_path"].alias("file"), at["row_index"].alias("pos"), text.alias("text"))

    def _source(self) -> str:
        """The path; one file as a pattern, since the stream watches folders and patterns."""
        folder, name = self.path.rsplit("/", 1)
        single = (name, False) in list_entries(self.spark, folder)
        return f"{folder}/{{{name}}}" if single else self.path

    def _batch_option(self, path: str) -> tuple[str, str]:
        if self.files_per_batch:
            return "maxFilesPerTrigger", str(self.files_per_batch)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        return "maxBytesPerTrigger", str(max(LEAST_BATCH, size // BATCHES))

    # -- streams -----------------------------------------------------------------------------------

    def ingest(self) -> None:
        """Takes all files in that neither this nor an earlier call has read."""
        schema = self.spark.read.parquet(self.path).schema
        docs = self.spark.readStream.schema(schema).option(*self._batch_option(self.path)).parquet(self._source())
        (self._located(docs).drop("text").writeStream.format("parquet").option("path", f"{self.store}/fingerprints")
         .option("checkpointLocation", f"{self.store}/checkpoint-fingerprints").trigger(availableNow=True).start().awaitTermination())
        if not list_entries(self.spark, f"{self.store}/fingerprints"):
            return
        prints = self.spark.readStream.schema(FINGERPRINT).option(*self._batch_option(f"{self.store}/fingerprints")).parquet(f"{self.store}/fingerprints")
        entries = prints.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "pos")).alias("last"))
        with _state_on_disk(self.spark):
            query = (entries.writeStream.outputMode("update").foreachBatch(self._put)
                     .option("checkpointLocation", f"{self.store}/checkpoint-state").trigger(availableNow=True).start())
        query.awaitTermination()

    def _put(self, changed: DataFrame, batch: int) -> None:
        """A batch that runs again replaces its own folder."""
        changed.write.mode("overwrite").parquet(f"{self.store}/changes/batch={batch}")

    # -- tables ------------------------------------------------------------------------------------

    def fingerprints(self) -> DataFrame:
        if not list_entries(self.spark, f"{self.store}/fingerprints"):
            return self.spark.createDataFrame([], FINGERPRINT)
        return self.spark.read.schema(FINGERPRINT).parquet(f"{self.store}/fingerprints")

    def state(self) -> DataFrame:
        """digest, n, last of every digest, as the last batch that touched it left them (both only grow)."""
        if not list_entries(self.spark, f"{self.store}/changes"):
            return self.spark.createDataFrame([], ENTRY)
        changes = self.spark.read.schema(ENTRY).parquet(f"{self.store}/changes")
        return changes.groupBy("digest").agg(F.max("n").alias("n"), F.max("last").alias("last"))

    def _hit_contents(self, dups: DataFrame, n_dups: int) -> DataFrame:
        """Rows, with their texts, whose digest several rows have (and a few more: the bitmap is not exact)."""
        bits = min(MOST_BITS, max(1 << 15, 1 << (n_dups * BITS_EACH).bit_length()))
        place = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
        bitmap = (dups.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
                  .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")))
        docs = self._located(self.spark.read.parquet(self.path))
        docs = docs.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("bit", F.bitmap_bit_position(place))
        byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return (docs.join(F.broadcast(bitmap), "bucket").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
                .select("doc_id", "digest", "file", "pos", "text"))

    def classes(self, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """The state's entries; those of hits, their contents checked; and, of digests under which different
        contents were found, (doc_id, digest, file, pos, n, last) of each row. None if there are none."""
        state = scratch.write(self.state(), "state")
        dups = state.where("n > 1")
        n_dups = dups.count()
        if not n_dups:
            return state, dups, None
        hits = scratch.write(self._hit_contents(dups, n_dups), "hits")
        # copies combine in their tasks: a row for each different content of a digest is left
        contents = (hits.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "pos")).alias("last")))
        contents = scratch.write(contents, "contents")
        at = dups.select("digest", F.col("last.file").alias("file"), F.col("last.pos").alias("pos"))
        located = hits.join(at, ["digest", "file", "pos"]).select("digest", F.col("text").alias("kept_text"))
        other = contents.join(located, "digest").where("text != kept_text").select("digest").distinct()
        mixed = scratch.write(other, "mixed-digests")
        if mixed.isEmpty():
            return state, dups, None
        apart = contents.join(mixed, "digest", "left_semi").select("digest", "text", "n", "last")
        rows = hits.join(mixed, "digest", "left_semi").join(apart, ["digest", "text"])
        return state, dups.join(mixed, "digest", "left_anti"), scratch.write(rows.drop("text"), "mixed-rows")

    def result(self, scratch: Scratch | None = None) -> DataFrame:
        """doc_id, keep_id, group_size, kept, digest for each row taken in, those that go included."""
        scratch = scratch or Scratch(self.spark, "streaming-dedup")
        state, dups, mixed = self.classes(scratch)
        rows = self.fingerprints()
        if mixed is not None:
            rows = rows.join(mixed.select("digest").distinct(), "digest", "left_anti")
        total = state.agg(F.sum("n").alias("n")).first().n or 0
        # the few hot digests are broadcast, so that their rows stay where they are; the others meet by digest
        hot = dups.where(F.col("n") * HOT > total).select("digest", F.col("n").alias("hot_n"), F.col("last").alias("hot_last"))
        rows = rows.join(F.broadcast(hot), "digest", "left")
        rest = rows.where("hot_n is null").drop("hot_n", "hot_last").join(dups, "digest", "left")
        rest = rest.withColumn("n", F.coalesce("n", F.lit(1))).withColumn("last", F.coalesce("last", F.struct("doc_id", "file", "pos")))
        found = rest.unionByName(rows.where("hot_n is not null").withColumnsRenamed({"hot_n": "n", "hot_last": "last"}))
        if mixed is not None:
            found = found.unionByName(mixed)
        kept = (F.col("file") == F.col("last.file")) & (F.col("pos") == F.col("last.pos"))
        return found.select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")


def exact_dedup(spark: SparkSession, path: str, scratch: Scratch | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for each row of the table at ``path``: see StreamingDedup,
    here with a state of its own in the scratch folder."""
    scratch = scratch or Scratch(spark, "streaming-dedup")
    dedup = StreamingDedup(spark, path, f"{scratch.root}/store", digest)
    dedup.ingest()
    return dedup.result(scratch)
