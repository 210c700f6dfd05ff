"""Tables that grow batch by batch in a shared folder, each batch once.

A batch's rows are written under its number, then a commit under the same
number. Readers take committed batches only, so a batch that failed on the way
leaves nothing to see and is written anew, over what it left, when it comes
again; one that is committed is passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class Committed:
    """Tables of a folder by name, each a folder of batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))

    def _store(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self, kind: str = "commits") -> list[int]:
        """The numbers of the committed batches (kind `bases`: of the merged ones), in order."""
        store = self._store()
        return sorted(int(x.getPath().getName()) for x in (store.listStatus(self._path(kind)) if store.exists(self._path(kind)) else ()) if store.exists(self._path(kind, x.getPath().getName(), "_SUCCESS")))

    def digest(self, batch: int) -> str:
        return self.spark.read.text(f"{self.folder}/commits/{batch}").first()["value"]

    def write(self, df: DataFrame, table: str, batch: int | str, *, format: str = "parquet") -> None:
        df.write.mode("overwrite").format(format).save(f"{self.folder}/{table}/{batch}")

    def commit(self, batch: int, digest: str = "", kind: str = "commits") -> None:
        # A commit is whole or not there: Spark's own marker is its last file.
        self.spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{kind}/{batch}")

    def read(self, table: str, schema: T.StructType | str, *, format: str = "parquet", kind: str = "commits", batches: Sequence[int | str] | None = None) -> DataFrame:
        """The rows of a table's committed batches, or of those named."""
        numbers = self.batches(kind) if batches is None else batches
        paths = [f"{self.folder}/{table}/{n}" for n in numbers]
        return self.spark.read.schema(schema).format(format).load(paths) if paths else self.spark.createDataFrame([], schema)

    def drop(self, table: str, batch: int | str) -> None:
        self._store().delete(self._path(table, batch), True)


def row_digest(df: DataFrame) -> str:
    """Count and order-free sum of hashes of a batch's rows: whether it is the one that came before."""
    row = df.select(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("h")).first()
    return f"{row['n']}:{row['h']}"


def once(tables: Committed, work: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """work as a foreachBatch function that does each batch once.

    A batch whose number is committed with other rows raises: the folder belongs
    to another stream or checkpoint, and passing over it would lose rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        digest = row_digest(batch)
        if number in tables.batches():
            if tables.digest(number) != digest:
                raise ValueError(f"batch {number} is committed in {tables.folder} with other rows")
            return
        work(batch, number)
        tables.commit(number, digest)

    return run


def pairs_sink(tables: Committed, right: DataFrame, score, *, known: DataFrame | None = None, on: Sequence[str] = (), format: str = "csv", table: str = "pairs") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each row of a batch with all rows of right, less the known pairs (by the columns `on`), scored and written once.

    score maps the joined frame to what is written. Pairs are made as they are
    written; no more than a batch's rows times right's exist in any run.
    """

    def work(batch: DataFrame, number: int) -> None:
        pairs = batch.crossJoin(right)
        if known is not None:
            pairs = pairs.join(known.select(*on), list(on), "left_anti")
        tables.write(score(pairs), table, number, format=format)

    return once(tables, work)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None):
    """Runs a stream through a foreachBatch function: over what is there, and returns when done; with `every` (as `5 minutes`) on until stopped."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()
    return query
