"""File listings, Markdown and binary sources, and table sinks.

A listing is a table (path, mtime, size), ``client/file`` paths; operators over
it are DataFrame functions, so a listing of any length stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that mark processed files and empty clients.
PROCESSED = "read-"
KEEP = ".keep"


def _parts(listing: DataFrame) -> DataFrame:
    at = F.instr("path", "/")
    return listing.where(at > 0).select(F.substring_index("path", "/", 1).alias("client"), F.substr("path", at + 1).alias("file"), *[c for c in listing.columns if c != "path"])


def clients(listing: DataFrame) -> DataFrame:
    """Top-level folders; files at the root have none."""
    return _parts(listing).select("client").distinct()


def _files(listing: DataFrame) -> DataFrame:
    return _parts(listing).where((F.col("file") != "") & (F.col("file") != KEEP) & ~F.contains("file", F.lit("/")))


def display(file: Column) -> Column:
    return F.regexp_replace(file, f"^{PROCESSED}", "")


def uploaded_files(listing: DataFrame, include_processed: bool = False) -> DataFrame:
    """client, file; without those already processed unless asked for."""
    files = _files(listing).select("client", "file")
    return files if include_processed else files.where(~F.startswith("file", F.lit(PROCESSED)))


def processed_files(listing: DataFrame) -> DataFrame:
    return _files(listing).where(F.startswith("file", F.lit(PROCESSED))).select("client", display(F.col("file")).alias("file"))


def all_files(listing: DataFrame) -> DataFrame:
    """client, file under display names, each once."""
    return _files(listing).select("client", display(F.col("file")).alias("file")).distinct()


def view_files(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """client, file, path, mime of wanted (client, file): the file itself, else its processed form; no row if neither is there."""
    files = _files(listing).select("client", F.col("file").alias("name"), display(F.col("file")).alias("shown"))
    raw = F.col("name") == F.col("file")
    hit = wanted.join(files.select("client", "name", F.explode(F.array_distinct(F.array("name", "shown"))).alias("file")), ["client", "file"])
    best = hit.groupBy("client", "file").agg(F.min_by("name", F.when(raw, 0).otherwise(1)).alias("name"))
    mime = F.when(F.endswith(F.lower("file"), F.lit(".pdf")), "application/pdf").otherwise("application/octet-stream")
    return best.select("client", "file", F.concat_ws("/", "client", "name").alias("path"), mime.alias("mime"))


def pending_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files without a manifest entry of the same name, time and size."""
    return listing.join(manifest.select("file", "mtime", "size"), ["file", "mtime", "size"], "left_anti")


def missing_locally(remote: DataFrame, local: DataFrame, force: bool = False) -> DataFrame:
    return remote if force else remote.join(local.select("file"), "file", "left_anti")


def new_clients(names: DataFrame, listing: DataFrame) -> DataFrame:
    """Placeholder paths of clients that have none yet; blank names make none."""
    wanted = names.where(F.trim("client") != "").select(F.concat("client", F.lit(f"/{KEEP}")).alias("path")).distinct()
    return wanted.join(listing.select("path"), "path", "left_anti")


def read_markdown(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """source (file name), utility (parent folder), text, mtime, size of every Markdown file below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    return files.select(*path_columns(F.col("_metadata.file_path")), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"))


def path_columns(path: Column) -> list[Column]:
    parts = F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/")
    return [F.element_at(parts, -1).alias("source"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("utility")]


def read_binary(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content; the content is read only where it is selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path below the folder, mtime and size, without reading any content."""
    files = read_binary(spark, folder, glob)
    root = folder.rstrip("/").split("://")[-1].replace("file:", "") + "/"
    return files.select(F.element_at(F.split("path", F.lit(f"\\Q{root}\\E"), 2), -1).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def read_json(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """path, raw of JSON files; ``raw`` is null where a file holds no JSON."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("raw"))


def read_vector_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a JSON-lines vector cache; ``seq`` orders the lines as they are in the file, however it is split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    return lines.select(F.struct("file", "at", "n").alias("seq"), F.col("value").alias("line"))


def read_database(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table, or a query in brackets with a name, over JDBC; ``options`` as Spark's (driver, partitionColumn, ...)."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_database(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def by_prefix(listing: DataFrame, prefix: str) -> DataFrame:
    return listing.where(F.startswith("path", F.lit(prefix)))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a file or a folder with all it holds (a cache that is cleared); false if there is none."""
    fs, at = _file_system(spark, path)
    return fs.delete(at, True)


def rename_to_processed(spark: SparkSession, root: str, client: str, file: str) -> str | None:
    """``client/file`` becomes ``client/read-file``; its new path, or none if the file is not there."""
    fs, old = _file_system(spark, f"{root}/{client}/{file}")
    new = f"{client}/{PROCESSED}{file}"
    if not fs.exists(old):
        return None
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{new}")
    fs.delete(target, False)
    return new if fs.rename(old, target) else None


def read_chunk_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunk rows from files that each hold one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrites a Parquet table, partitioned where asked."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def create_index(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def delete_index(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def index_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
