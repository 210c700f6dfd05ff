"""Records matched to entities by methods in a fixed order, each with its confidence: keys, names, abbreviations, likeness, structures, landed cross-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.operators.resolve import NEAR_TIE, alike_names, unique_names

# How sure each method is, and whether a match by it is to be reviewed.
METHODS: dict[str, tuple[float, bool]] = {
    "exact": (1.0, False),
    "block": (0.9, False),
    "name": (0.85, False),
    "abbreviation": (0.9, True),
    "fuzzy": (0.7, True),
    "structure": (0.5, True),
    "xref": (0.6, True),
}


def expansions_with(expansions: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(abbreviation, name) lower-cased and trimmed, a run's additions before the table's own; an abbreviation that stands for several names stands for none.

    Null or empty ones, and those that stand for themselves, are left out.
    """
    def tidy(df: DataFrame, turn: int) -> DataFrame:
        own = df.select(F.lower(F.trim("abbreviation")).alias("abbreviation"), F.lower(F.trim("name")).alias("name"), F.lit(turn).alias("turn"))
        return own.where("abbreviation <> '' and name <> '' and abbreviation <> name")

    both = tidy(expansions, 1) if more is None else tidy(expansions, 1).unionByName(tidy(more, 0))
    first = both.groupBy("abbreviation").agg(F.min("turn").alias("turn"))
    own = both.join(first, ["abbreviation", "turn"]).groupBy("abbreviation").agg(F.min("name").alias("name"), F.max("name").alias("last"))
    return own.where("name = last").select("abbreviation", "name")


def match_records(records: DataFrame, entities: DataFrame, *, record_id: str, key: str, name: str, structure: str | None = None, expansions: DataFrame | None = None, xrefs: DataFrame | None = None, block: int = 14, fuzzy: float | None = 0.85) -> DataFrame:
    """(record_id, match, method, confidence, needs_review) of records against entities, both with key, name and, if named, structure.

    The first method that hits: `exact`, the same key; `block`, the same first
    `block` letters of the key (the smallest such key); `name`, the same name;
    `abbreviation`, the name that expansions(abbreviation, name) has for the
    record's; `fuzzy`, the name most alike, refused where another comes within
    NEAR_TIE; `structure`, the same trimmed text of a structure; `xref`, the key
    of an entity that xrefs(name, key), a landed lookup, has for the name. A
    name, an expansion, a structure or a cross-reference that leads to several
    entities matches nothing, and the next method is asked.

    Names should be normalised as expansions_with() does. Null and empty values
    match nothing; repeated records are each given; records without a match have
    null method and confidence 0. Only records that no method before `fuzzy` matched
    are compared by likeness.
    """
    def text(c: str) -> Column:
        return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))

    own = {"key": key, "name": name} | ({"structure": structure} if structure else {})
    r = records.select(F.col(record_id).alias("record_id"), *[text(c).alias(f"r_{n}") for n, c in own.items()])
    e = entities.select(*[text(c).alias(n) for n, c in own.items()]).where("key is not null")
    names = unique_names(e, "key", "name").select(F.col("name").alias("on"), F.col("key").alias("match"))

    def found(method: str, column: Column, table: DataFrame) -> None:
        nonlocal r
        side = table.select(F.col("on").alias("_on"), F.col("match").alias(f"m_{method}"))
        r = r.withColumn("_by", column).join(side, F.col("_by") == F.col("_on"), "left").drop("_by", "_on")

    done: list[str] = []

    def ask(method: str, column: Column, table: DataFrame) -> None:
        found(method, column, table)
        done.append(method)

    ask("exact", F.col("r_key"), e.select(F.col("key").alias("on"), F.col("key").alias("match")).distinct())
    ask("block", F.when(F.length("r_key") >= block, F.substring("r_key", 1, block)), e.where(F.length("key") >= block).groupBy(F.substring("key", 1, block).alias("on")).agg(F.min("key").alias("match")))
    ask("name", F.col("r_name"), names)
    if expansions is not None:
        ask("abbreviation", F.col("r_name"), expansions.join(names, F.col("name") == F.col("on")).select(F.col("abbreviation").alias("on"), "match"))
    if fuzzy is not None:
        left = r.where(" and ".join(f"m_{m} is null" for m in done)).select(F.col("r_name").alias("r"))
        near = alike_names(left, names.select(F.col("on").alias("e")), base=fuzzy)
        best = near.groupBy("r").agg(F.max_by("e", "s").alias("e"), F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 2).alias("s"))
        sure = best.where((F.size("s") < 2) | (F.element_at("s", 1) - F.element_at("s", -1) > NEAR_TIE + 1e-9))
        ask("fuzzy", F.col("r_name"), sure.join(names, F.col("e") == F.col("on")).select(F.col("r").alias("on"), "match"))
    if structure:
        ask("structure", F.col("r_structure"), unique_names(e, "key", "structure").select(F.col("name").alias("on"), F.col("key").alias("match")))
    if xrefs is not None:
        known = xrefs.select(text("name").alias("name"), text("key").alias("key")).join(e.select("key").distinct(), "key", "left_semi")
        ask("xref", F.col("r_name"), unique_names(known, "key", "name").select(F.col("name").alias("on"), F.col("key").alias("match")))
    method = F.coalesce(*[F.when(F.col(f"m_{m}").isNotNull(), F.lit(m)) for m in done])
    sure = F.coalesce(*[F.when(F.col(f"m_{m}").isNotNull(), F.lit(METHODS[m][0])) for m in done], F.lit(0.0))
    review = F.coalesce(*[F.when(F.col(f"m_{m}").isNotNull(), F.lit(METHODS[m][1])) for m in done], F.lit(False))
    return r.select("record_id", F.coalesce(*[F.col(f"m_{m}") for m in done]).alias("match"), method.alias("method"), sure.alias("confidence"), review.alias("needs_review"))
