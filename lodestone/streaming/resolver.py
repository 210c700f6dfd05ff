"""Entities resolved over a stream of records, with state that is kept between runs.

State is made of parts that merge in any order: of each key and field the best
ranked value, of each name the least and greatest key, and the records without a
key by their name. A batch adds its own parts only; what is known is merged when
it is asked for, so that records which came before their key are resolved as
those which came after. Parts are merged to one now and then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestone.streaming.committed import Committed, once

_TABLES = ("keyed", "loose", "names")


class ResolverState:
    """The state in a shared folder. Records have key, name, source, rank and the fields; lower ranks win, ties to the lesser value.

    apply is the function of foreachBatch. One stream writes to a folder.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: dict[str, str], *, merge_after: int = 16):
        """fields: the type of each field by its name. merge_after: so many batches' parts are merged to one."""
        self.spark, self.fields, self.merge_after = spark, dict(fields), merge_after
        self.tables = Committed(spark, folder)
        self.apply = once(self.tables, self._add)

    def _schema(self, table: str) -> T.StructType:
        kinds = ", ".join(f"`best_{c}` struct<rank: bigint, value: {kind}>" for c, kind in self.fields.items())
        own = {"keyed": "key string", "loose": "name string"}
        text = "name string, low string, high string" if table == "names" else f"{own[table]}, {kinds}, sources array<string>, n bigint"
        return T.StructType.fromDDL(text)

    def _best(self, c: str) -> Column:
        return F.min(F.col(f"best_{c}")).alias(f"best_{c}")

    def _merged(self, parts: DataFrame, by: str) -> DataFrame:
        sources = F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources")
        return parts.groupBy(by).agg(*[self._best(c) for c in self.fields], sources, F.sum("n").alias("n"))

    @staticmethod
    def _names(parts: DataFrame) -> DataFrame:
        return parts.groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def _add(self, batch: DataFrame, number: int) -> None:
        text = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("key", "name")}
        rank = F.col("rank").cast("long")
        best = [F.when(F.col(c).isNotNull(), F.struct(rank.alias("rank"), F.col(c).cast(kind).alias("value"))).alias(f"best_{c}") for c, kind in self.fields.items()]
        own = batch.select(text["key"].alias("key"), text["name"].alias("name"), *best, F.array_compact(F.array(F.col("source").cast("string"))).alias("sources"), F.lit(1).cast("long").alias("n"))
        keyed, loose = own.where("key is not null"), own.where("key is null")
        self.tables.write(self._merged(keyed, "key"), "keyed", number)
        self.tables.write(self._merged(loose, "name"), "loose", number)
        self.tables.write(self._names(keyed.where("name is not null").select("name", F.col("key").alias("low"), F.col("key").alias("high"))), "names", number)
        bases = self.tables.batches("bases")
        if len([n for n in self.tables.batches() if not bases or n > bases[-1]]) >= self.merge_after:
            self._merge()

    def _merge(self) -> None:
        """One base of all committed parts; what it holds is dropped once it is committed."""
        done = self.tables.batches()
        old = self.tables.batches("bases")
        for table in _TABLES:
            self.tables.write(self._state(table), table, f"base-{done[-1]}")
        self.tables.commit(done[-1], kind="bases")
        for table in _TABLES:
            for n in [*[n for n in done if not old or n > old[-1]], *[f"base-{n}" for n in old]]:
                self.tables.drop(table, n)

    def _state(self, table: str) -> DataFrame:
        bases = self.tables.batches("bases")
        parts: list[int | str] = [n for n in self.tables.batches() if not bases or n > bases[-1]]
        rows = self.tables.read(table, self._schema(table), batches=[*[f"base-{n}" for n in bases[-1:]], *parts])
        return self._names(rows) if table == "names" else self._merged(rows, "key" if table == "keyed" else "name")

    def _resolved(self) -> DataFrame:
        """Records without a key with the key that their name leads to; low and high differ where it leads to several."""
        return self._state("loose").join(self._state("names"), "name", "left")

    def entries(self) -> DataFrame:
        """key, the fields, sources (joined by |), n records: all that the committed batches hold."""
        loose = self._resolved().where("low = high")
        keyed = self._state("keyed")
        both = keyed.unionByName(loose.select(F.col("low").alias("key"), *keyed.columns[1:]))
        return self._merged(both, "key").select("key", *[F.col(f"best_{c}.value").alias(c) for c in self.fields], F.array_join("sources", "|").alias("sources"), "n")

    def unresolved(self) -> DataFrame:
        """name, reason, n of records whose name is missing, unknown or leads to several keys."""
        reason = F.when(F.col("name").isNull(), "no name").when(F.col("low").isNull(), "unknown name").when(F.col("low") != F.col("high"), "several keys")
        return self._resolved().withColumn("reason", reason).where("reason is not null").select("name", "reason", "n")

    def snapshot(self, folder: str, *, hidden: Sequence[str] = ()) -> None:
        """Writes the state as it is to a folder that restore() takes; the values of hidden fields are left out of it, and names are hashed."""
        out = Committed(self.spark, folder)
        for table in _TABLES:
            rows = self._state(table)
            if hidden:
                rows = rows.withColumns({f"best_{c}": F.lit(None).cast(rows.schema[f"best_{c}"].dataType) for c in hidden if table != "names"})
                rows = rows.withColumn("name", F.sha2("name", 256)) if table != "keyed" else rows
            out.write(rows, table, 0)
        out.commit(0, "snapshot")

    @classmethod
    def restore(cls, spark: SparkSession, snapshot: str, folder: str, fields: dict[str, str], **how) -> ResolverState:
        """A state in a new folder that begins with a snapshot; its stream begins with a new checkpoint."""
        state = cls(spark, folder, fields, **how)
        if state.tables.batches() or state.tables.batches("bases"):
            raise ValueError(f"{folder} holds a state")
        kept = Committed(spark, snapshot)
        if 0 not in kept.batches():
            raise ValueError(f"{snapshot} holds no snapshot")
        for table in _TABLES:
            state.tables.write(kept.read(table, state._schema(table)), table, "base--1")
        state.tables.commit(-1, kind="bases")
        return state
