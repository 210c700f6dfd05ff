"""Sources: typed readers that keep what they can't read, and parsers of line and tree formats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestone.functions.scalars import NULL_TOKENS


def typed_csv(spark: SparkSession, path: str, schema: T.StructType | str, *, sep: str = ",", header: bool = True, multi_line: bool = False, null_tokens: Sequence[str] = NULL_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected records) of delimited files, gz included; a BOM and placeholder strings, in fields of any type, become null.

    Every file's header line is dropped. Quotes inside quoted fields are doubled.
    With multi_line fields may hold line ends, and a file is read by one task;
    without it such records are rejected. A record is rejected that has other
    than the schema's number of fields or a field that isn't of its type.
    """
    schema = _parsed(spark, schema)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("_corrupt", T.StringType())])
    how = {"sep": sep, "header": header, "multiLine": multi_line, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "encoding": "UTF-8"}
    raw = spark.read.options(**how).schema(texts).csv(path)
    first = schema.names[0]
    raw = raw.withColumn(first, F.regexp_replace(f"`{first}`", "^\ufeff", ""))
    plain = raw.withColumns({n: F.when(~F.lower(F.trim(F.col(f"`{n}`"))).isin(*null_tokens), F.col(f"`{n}`")) for n in schema.names})
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    wrong = F.lit(False)
    for name, value in typed.items():
        wrong = wrong | (F.col(f"`{name}`").isNotNull() & value.isNull())
    marked = plain.withColumn("_wrong", F.col("_corrupt").isNotNull() | wrong)
    record = F.coalesce("_corrupt", F.concat_ws(sep, *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in schema.names]))
    return marked.where(~F.col("_wrong")).select(*[v.alias(n) for n, v in typed.items()]), marked.where("_wrong").select(record.alias("_corrupt"))


def _parsed(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def spaced_table(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """A text table parted by runs of white space, its header line dropped; short lines give nulls."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "").where(F.element_at(F.split(F.trim("value"), r"\s+"), 1) != names[0])
    return lines.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def commented_tsv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """A tab-separated file whose lines that begin with # are comments."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(*[F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)])


def triples(df: DataFrame, head: str = "head", relation: str = "relation", tail: str = "tail") -> DataFrame:
    """Type::id ends and Source::relation::A:B names taken apart."""
    h, r, t = (F.split(F.col(c), "::") for c in (head, relation, tail))
    return df.select(F.get(h, F.lit(0)).alias("head_type"), F.get(h, F.lit(1)).alias("head_id"), F.get(r, F.lit(0)).alias("relation_source"), F.get(r, F.lit(1)).alias("relation_name"), F.get(t, F.lit(0)).alias("tail_type"), F.get(t, F.lit(1)).alias("tail_id"))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good records, rejected lines) of a JSON-lines file, gz included."""
    row = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    raw = spark.read.text(path).where(F.trim("value") != "").select(row.alias("r")).select("r.*")
    return raw.where("_corrupt is null").drop("_corrupt"), raw.where("_corrupt is not null").select("_corrupt")


def children(df: DataFrame, key: str, nested: str) -> DataFrame:
    """A row for each element of a column of structs, with its record's key and its place from 0; records without one give none."""
    return df.select(key, F.posexplode(nested).alias("place", "_child")).select(key, "place", "_child.*")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """A row for each element row_tag of XML files, which are split between tasks; nested elements by a schema of structs and arrays, missing ones null."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def flat_records(spark: SparkSession, path: str, *, end: str = "//\n") -> DataFrame:
    """Line-code records that end with //: id, accessions, gene, organism, taxon, sequence."""
    raw = spark.read.option("lineSep", end).text(path).where(F.trim("value") != "")
    v = F.col("value")
    accessions = F.regexp_extract_all(v, F.lit(r"(?m)^AC   (.*)$"), 1)
    sequence = F.regexp_replace(F.regexp_extract(v, r"(?s)\nSQ [^\n]*\n(.*)$", 1), r"\s+", "")
    return raw.select(
        F.regexp_extract(v, r"(?m)^ID   (\S+)", 1).alias("id"),
        F.array_join(F.filter(F.transform(F.split(F.array_join(accessions, " "), ";"), lambda x: F.trim(x)), lambda x: x != ""), "|").alias("accessions"),
        F.nullif(F.regexp_extract(v, r"(?m)^GN   Name=([^;{ ]+)", 1), F.lit("")).alias("gene"),
        F.nullif(F.trim(F.regexp_extract(v, r"(?m)^OS   ([^.\n(]+)", 1)), F.lit("")).alias("organism"),
        F.nullif(F.regexp_extract(v, r"NCBI_TaxID=(\d+)", 1), F.lit("")).cast("long").alias("taxon"),
        F.nullif(sequence, F.lit("")).alias("sequence"),
    )


def soft_samples(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the sample tables of SOFT files: sample_id, title, id_ref, value. Files are split between samples; a task holds one sample's text.

    Values that aren't numbers are null; samples without a table give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0).to_pylist():
                sample = title = None
                table = head = None
                lines = text.splitlines()
                if lines and lines[0].lstrip().startswith("="):  # what follows a separator
                    lines[0] = "^SAMPLE" + lines[0]
                for line in lines:
                    if line.startswith("^SAMPLE"):
                        sample, title = line.partition("=")[2].strip(), None
                    elif line.startswith("!Sample_title"):
                        title = line.partition("=")[2].strip()
                    elif line.startswith("!sample_table_begin"):
                        table, head = True, None
                    elif line.startswith("!sample_table_end"):
                        table = None
                    elif table and head is None:
                        head = line.split("\t")
                    elif table:
                        cells = dict(zip(head, line.split("\t"), strict=False))
                        try:
                            value = float(cells.get("VALUE", ""))
                        except ValueError:
                            value = None
                        rows.append((sample, title, cells.get("ID_REF"), value))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["sample_id", "title", "id_ref", "value"])

    return spark.read.option("lineSep", "\n^SAMPLE").text(path).mapInArrow(run, "sample_id string, title string, id_ref string, value double")


def phenotypes(df: DataFrame, column: str) -> DataFrame:
    """'Name, 123456 (3)' taken apart: name, mim (6 digits), mapping_key."""
    return df.withColumns(
        {
            "name": F.trim(F.regexp_replace(F.regexp_replace(column, r"\s*\(\d\)\s*$", ""), r",?\s*\d{6}\s*$", "")),
            "mim": F.nullif(F.regexp_extract(column, r"(\d{6})\s*(?:\(\d\))?\s*$", 1), F.lit("")),
            "mapping_key": F.nullif(F.regexp_extract(column, r"\((\d)\)\s*$", 1), F.lit("")).cast("int"),
        }
    )


def latest_file(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The newest file of a folder by time of change, then path: path, length, modified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    return files.orderBy(F.col("modificationTime").desc(), F.col("path").desc()).limit(1)


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str, *, batch: int = 10_000) -> DataFrame:
    """Rows of a query on a SQLite file that every machine can open, read in batches by one task."""
    names = _parsed(spark, schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for one in batches:
            if not len(one):
                continue
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                cursor = db.execute(query)
                while rows := cursor.fetchmany(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return spark.range(0, 1, 1, 1).mapInArrow(run, schema)
