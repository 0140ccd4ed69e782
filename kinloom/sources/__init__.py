"""Readers and writers of the batch workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "pair_id string, left_path string, right_path string"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, language): whole files."""
    from kinloom.functions.lexical import language_of

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.withColumn("language", language_of(F.col("path")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a CSV manifest; blank and short rows are left out."""
    return spark.read.csv(path, schema=MANIFEST, header=True, mode="DROPMALFORMED").where("pair_id is not null and left_path is not null and right_path is not null")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a row cut short by a crash is left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def read_table(spark: SparkSession, url: str, query: str, partition: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A query over JDBC; with a partition column and (low, high, n) it is read in n parts."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options)
    if partition and bounds:
        reader = reader.options(partitionColumn=partition, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(bounds[2]))
    return reader.load()


def remaining(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs without a result yet."""
    return manifest.join(done.select("pair_id").distinct(), "pair_id", "left_anti")


def cut_fragment(text: Column, start: Column, end: Column, name: str | None = None, imports: Column | None = None) -> Column:
    """Lines start to end (from 1), null where they are out of bounds; with a name, wrapped in a class."""
    lines = F.split(text, "\n")
    inside = (start >= 1) & (end >= start) & (end <= F.size(lines))
    body = F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")
    if name:
        head = F.concat(F.coalesce(imports, F.lit("")), F.lit(f"class {name} {{\n")) if imports is not None else F.lit(f"class {name} {{\n")
        body = F.concat(head, body, F.lit("\n}\n"))
    return F.when(inside, body)


def resolve(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """(name, path): each wanted name's path of least rank; null where no place has it. places: (name, rank, path)."""
    best = places.groupBy("name").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return wanted.join(best, "name", "left")


def raw_records(program: DataFrame) -> DataFrame:
    """(path, channel, value) in pre-order from nested classes of methods of blocks of instructions, each with ``raw`` array<struct<channel, value>>."""
    c = program.select(F.posexplode("classes").alias("ci", "c"))
    m = c.select("ci", F.posexplode("c.methods").alias("mi", "m"))
    b = m.select("ci", "mi", F.posexplode("m.blocks").alias("bi", "b"))
    i = b.select("ci", "mi", "bi", F.posexplode("b.instructions").alias("ii", "i"))
    levels = [(c, "c.raw", ["ci"]), (m, "m.raw", ["ci", "mi"]), (b, "b.raw", ["ci", "mi", "bi"]), (i, "i.raw", ["ci", "mi", "bi", "ii"])]
    parts = [df.select(F.concat_ws(".", *[F.lpad(F.col(x).cast("string"), 6, "0") for x in at]).alias("path"), F.explode(raw).alias("r")).select("path", "r.channel", "r.value") for df, raw, at in levels]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def record_json(records: DataFrame, tool: str, version: str) -> DataFrame:
    return records.select("path", F.to_json(F.struct(F.lit(tool).alias("toolName"), F.lit(version).alias("toolVersion"), "channel", F.col("value").alias("rawValue"))).alias("line"))
