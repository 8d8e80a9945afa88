"""File sources and sinks: event log, manifests, status, text, frozen and versioned tables, relational tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import tomllib
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.lineage import shared_path
from riskloom.operators.timeline import dedup
from riskloom.schemas import ENVELOPE, MANIFEST, STATUS_FILE

from .adapters import digest


def event_log(spark: SparkSession, path: str, kind: str = "json", stream: bool = False, **options) -> DataFrame:
    """Envelopes from files, in batch or as a stream, with the declared schema. ``kind`` "kafka" reads topics where the
    connector is on the class path, ``path`` being the topic and ``options`` those of the connector."""
    if kind == "kafka":
        reader = spark.readStream if stream else spark.read
        raw = reader.format("kafka").options(subscribe=path, **options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), ENVELOPE).alias("e")).select("e.*")
    reader = (spark.readStream if stream else spark.read).schema(ENVELOPE).options(**options)
    return reader.format(kind).load(path)


def manifests(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Run manifests by run_id; files that are not JSON or have no run id are passed over. Of one run id the file
    last in order of name counts."""
    raw = spark.read.schema(T.StructType([*MANIFEST.fields, T.StructField("_corrupt_record", T.StringType())])).option("multiLine", True).option("mode", "PERMISSIVE").json(path, pathGlobFilter=glob)
    rows = raw.select("*", F.col("_metadata.file_path").alias("file")).filter(F.coalesce(F.col("run_id"), F.lit("")) != "").drop("_corrupt_record")
    newest = rows.groupBy("run_id").agg(F.max("file").alias("file"))
    return rows.join(newest, ["run_id", "file"], "left_semi").drop("file")


def capabilities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATUS_FILE).option("multiLine", True).json(path).select("project", "current_phase", F.explode("capabilities").alias("c")).select("project", "current_phase", "c.*")


def texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pins(spark: SparkSession, path: str, table: str = "tool.pins") -> dict[str, str]:
    """Version pins from a TOML table, wherever Spark can read it; raises where the table is absent."""
    found = tomllib.loads(spark.read.text(path, wholetext=True).first()[0])
    for part in table.split("."):
        if part not in found:
            raise KeyError(f"{path} has no [{table}]")
        found = found[part]
    return {k: str(v) for k, v in found.items()}


def freeze(df: DataFrame, path: str, name: str) -> dict:
    """Write a dataset once and return what pins it. Writing over an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)
    rows, d = digest(df.sparkSession.read.parquet(path))
    return {"name": name, "path": path, "rows": rows, "digest": d}


def thaw(spark: SparkSession, pin: dict) -> DataFrame:
    df = spark.read.parquet(pin["path"])
    rows, d = digest(df)
    if (rows, d) != (pin["rows"], pin["digest"]):
        raise ValueError(f"{pin['name']} is not the dataset that was pinned")
    return df


def save_version(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_version(spark: SparkSession, path: str, version: int, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/version={version}")


def laid_out(df: DataFrame, path: str, partition: str | None, cluster: list[str], files: int) -> None:
    """Write for pruning: by directory of ``partition``, if any, and in ranges of ``cluster``, sorted within files, so
    that a reader's filters skip files and row groups by their statistics."""
    writer = df.repartitionByRange(files, *([partition] if partition else []), *cluster).sortWithinPartitions(*([partition] if partition else []), *cluster).write
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def merge(existing: DataFrame | None, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: the newest row per key of both; to be written as a new version, as plain files can't be merged."""
    both = updates if existing is None else existing.unionByName(updates, allowMissingColumns=True)
    return dedup(both, keys, [-F.unix_micros(F.col(order))])


def merge_edges(spark: SparkSession, existing: DataFrame | None, updates: DataFrame, path: str, part: str) -> DataFrame:
    """The graph's store: edges of both, each once, written as a new version by ``part`` of the source. Returns what was
    written."""
    both = updates if existing is None else existing.unionByName(updates)
    both.distinct().write.mode("errorifexists").partitionBy(part).parquet(path)
    return spark.read.schema(both.schema).parquet(path)


#: The embedded database that comes with Spark.
EMBEDDED = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def embedded(df: DataFrame, table: str, key: str) -> str:
    """URL of a read-only database, for driver class EMBEDDED, of one table of numbers and strings, indexed by ``key``.

    An embedded database is open in one process only, so tasks can neither fill nor share the driver's. Executors write
    the rows as text to the shared folder, the driver loads them file by file, and the database goes to every process as
    a jar, read in place from the class path. The jar lasts as long as the application."""
    spark: SparkSession = df.sparkSession
    jvm, home, name = spark.sparkContext._jvm, os.path.realpath(tempfile.mkdtemp(prefix="riskloom-")), f"db{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, home, ignore_errors=True)
    url, text, jar = f"jdbc:derby:{home}/{name}", shared_path(spark, "db"), f"{home}/{name}.jar"
    df.limit(0).write.jdbc(f"{url};create=true", table, properties={"driver": EMBEDDED})  # makes the table; no rows, so no task
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if kind == "string" else F.col(c).cast("string") for c, kind in df.dtypes]
    df.select(F.concat_ws(",", *(F.coalesce(q, F.lit("")) for q in quoted))).write.text(text, compression="none", lineSep="\n")
    Path = jvm.org.apache.hadoop.fs.Path
    store = Path(text).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    conn = jvm.java.sql.DriverManager.getConnection(url)
    try:
        load = conn.prepareStatement("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
        load.setString(1, table.upper())
        load.setString(2, f"{home}/part")
        for part in store.globStatus(Path(f"{text}/part-*")):
            store.copyToLocalFile(False, part.getPath(), Path(f"file://{home}/part"), True)
            load.execute()
        conn.createStatement().execute(f'CREATE INDEX {table}_key ON {table} ("{key}")')
    finally:
        conn.close()
        store.delete(Path(text), True)
    try:
        jvm.java.sql.DriverManager.getConnection(f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # which says that it is shut down
            raise
    with zipfile.ZipFile(jar, "w", zipfile.ZIP_STORED) as z:  # stored, so that a page is reached without inflating those before it
        for folder, _, names in os.walk(f"{home}/{name}"):
            for n in names:
                z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), home))
    shutil.rmtree(f"{home}/{name}")
    if os.path.exists(f"{home}/part"):
        os.remove(f"{home}/part")
    spark.sql(f"ADD JAR '{jar}'")
    return f"jdbc:derby:classpath:{name}"


def relational(spark: SparkSession, url: str, table: str, column: str, lower: int | None, upper: int | None, parts: int, **properties) -> DataFrame:
    """A database table read in parallel slices of a numeric column. Bounds that are None are the column's least and
    greatest value; they only place the slices, rows beyond them and without a value are read too."""
    if lower is None or upper is None:
        quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
        least, greatest = spark.read.jdbc(url, f"(SELECT min({quoted}) AS lo, max({quoted}) AS hi FROM {table}) b", properties=properties).first()
        if least is None:  # no value at all
            return spark.read.jdbc(url, table, properties=properties)
        lower, upper = least if lower is None else lower, greatest if upper is None else upper
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=properties)
