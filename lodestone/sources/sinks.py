"""Sinks: tables with digests, keyed upserts, rejected rows, graph exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.operators.joins import split_valid, upserted
from lodestone.shared import Scratch


def write_csv_with_digest(df: DataFrame, path: str, order: Sequence[str]) -> DataFrame:
    """CSV in order, and beside it path + '_digest' with rows and an order-free SHA-256 sum of the rows; returns the digest."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")
    out = digest(df)
    out.write.mode("overwrite").json(f"{path}_digest")
    return out


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest): the sum of the leading 60 bits of each row's SHA-256, which no order of rows changes."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("digest"))


def write_parquet(df: DataFrame, path: str, *, by: Sequence[str] = (), files: int | None = None) -> None:
    """Parquet in folders by the values of `by` (null has its own), in `files` tasks dealt by them; what is there is replaced."""
    df = df.repartition(files, *by) if files and by else df
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_chunks(df: DataFrame, path: str, position: str, size: int) -> None:
    """CSV files with headers in folders chunk=0, 1, ... of `size` successive positions each (from 0); the position isn't written.

    Chunks are dealt whole to tasks, in none of which more than one is held.
    """
    own = df.withColumn("chunk", F.floor(F.col(position) / size)).drop(position)
    own.repartition("chunk").write.mode("overwrite").partitionBy("chunk").csv(path, header=True)


def write_upsert(path: str, new_path: str, changes: DataFrame, keys: Sequence[str], order: Column, *, fill_only: bool = False) -> DataFrame:
    """The table at path with changes upserted, written to new_path (a table can't be read and overwritten at once)."""
    spark = changes.sparkSession
    upserted(spark.read.parquet(path), changes, keys, order, fill_only=fill_only).write.mode("overwrite").parquet(new_path)
    return spark.read.parquet(new_path)


def write_with_rejects(df: DataFrame, rules: dict[str, Column], path: str, rejects: str) -> None:
    """Valid rows to path; the others, as JSON with their reasons, appended to rejects."""
    good, bad = split_valid(df, rules)
    good.write.mode("overwrite").parquet(path)
    bad.select(F.to_json(F.struct(*df.columns)).alias("row"), "reason").write.mode("append").json(rejects)


def cypher_statements(nodes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A MERGE statement per node as text, strings quoted."""
    def quoted(c: Column) -> Column:
        return F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))

    sets = F.concat_ws(", ", *[F.concat(F.lit(f"n.{c} = "), quoted(F.col(c))) for c in fields])
    return nodes.select(F.concat(F.lit("MERGE (n:"), "label", F.lit(" {id: "), quoted(F.col("id")), F.lit("}) SET "), sets).alias("statement"))


def lineage(job: str, inputs: Sequence[str], outputs: Sequence[str]) -> dict:
    """A run's lineage in the open lineage event shape."""
    return {"eventType": "COMPLETE", "job": {"namespace": "lodestone", "name": job}, "inputs": [{"namespace": "file", "name": x} for x in inputs], "outputs": [{"namespace": "file", "name": x} for x in outputs]}


def replace_partitions(staged: DataFrame, path: str, by: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """Replaces in the Parquet table at path the partitions that staged rows have, by the columns `by`; all others keep their files.

    checks are conditions by name, that hold for every staged row: where one
    doesn't (null included), a ValueError says how many rows fail each and nothing is replaced. The
    staged rows are written beside the table first, so that they are computed
    once and may come from the table itself. Returns (by, rows) of what was replaced.
    """
    spark = staged.sparkSession
    scratch = Scratch(spark, "staged")
    staged = scratch.write(staged, "rows")
    failed = staged.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())]).first() if checks else ()
    if any(failed):
        raise ValueError("staged rows fail " + ", ".join(f"{name} ({n})" for name, n in zip(checks, failed, strict=True) if n))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return staged.groupBy(*by).agg(F.count("*").alias("rows"))
