"""Records with several nested levels taken apart to tables, with the keys of what they stand in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.shared import Scratch


@dataclass(frozen=True)
class Level:
    """A nested array: its field in the level above (dots go into structs), what its table takes of an element by name, and the levels in it.

    fields are SQL expressions over `item`, the element.
    """

    of: str
    fields: Mapping[str, str]
    levels: Mapping[str, Level] = field(default_factory=dict)


def parsed_once(records: DataFrame, text: str, schema: str, *, id: str, reader=F.from_json) -> tuple[DataFrame, DataFrame]:
    """(records with `record`, their text read by a schema, and their id; those that can't be read or have no id, with their text).

    The text is read once: what comes from either is written.
    """
    scratch = Scratch(records.sparkSession, "parsed")
    own = records.withColumn("record", reader(F.col(text), schema, {"mode": "PERMISSIVE"}))
    own = own.select(F.col(f"record.{id}").alias("id"), "record", F.col(text).alias("text"))
    good = F.col("id").isNotNull()
    own = scratch.write(own.withColumn("text", F.when(~good, F.col("text"))), "records")
    return own.where(good).select("id", "record"), own.where(~good).select("text")


def child_tables(records: DataFrame, levels: Mapping[str, Level], *, keys: Sequence[str] = ("id",), item: Column | None = None) -> dict[str, DataFrame]:
    """A table for each level at any depth: the keys of the record, `<level>_at` for each level on the way (places from 0), then its fields.

    Null and empty arrays and null elements give no rows. Only the parts of a
    record that a table asks for are read for it.
    """
    item = F.col("record") if item is None else item
    out = {}
    for name, level in levels.items():
        at = item
        for step in level.of.split("."):
            at = at[step]
        place = f"{name}_at"
        rows = records.select(*keys, F.posexplode(at).alias(place, "item")).where("item is not null")
        own = [*keys, place]
        out[name] = rows.select(*own, *[F.expr(e).alias(c) for c, e in level.fields.items()])
        out |= child_tables(rows, level.levels, keys=own, item=F.col("item"))
    return out


def interactions(pairs: DataFrame, known: DataFrame, *, id: str, other: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((a, b, text) of unordered pairs of known(id) records, once each with the first text that isn't null; (id, other, reason) of those left out).

    Left out are pairs of a record with itself, without another end, and with
    one that isn't known.
    """
    ids = known.select(F.col("id").alias("_known")).distinct()
    own = pairs.select(F.col(id).alias("id"), F.col(other).alias("other"), F.col(text).alias("text"))
    own = own.join(ids, F.col("other") == F.col("_known"), "left")
    reason = F.when(F.col("other").isNull(), "no other").when(F.col("id") == F.col("other"), "itself").when(F.col("_known").isNull(), "unknown")
    own = own.withColumn("reason", reason).drop("_known")
    good = own.where("reason is null").groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("text").alias("text"))
    return good, own.where("reason is not null").select("id", "other", "reason")
