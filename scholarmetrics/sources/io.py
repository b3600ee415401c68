"""Sources and sinks: corpus scan, catalog tables, CSV reports, staged results.

Scratch and stage locations come from the session: ``spark.checkpoint.dir``
names the shared folder of the cluster. Only on a local master is a temporary
folder created when it is unset.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_AU = T.StructType([
    T.StructField("auid", T.StringType()),
    T.StructField("authorseq", T.IntegerType()),
    T.StructField("surname_pn", T.StringType()),
    T.StructField("given_name_pn", T.StringType()),
    T.StructField("initials_pn", T.StringType()),
    T.StructField("indexed_name_pn", T.StringType()),
    T.StructField("indexed_name", T.StringType()),
])
_AU_AF = T.StructType([T.StructField("authorseq", T.IntegerType()), T.StructField("affiliation_seq", T.IntegerType())])
_AF = T.StructType([
    T.StructField("afid", T.LongType()),
    T.StructField("affiliation_ids", T.ArrayType(T.LongType())),
    T.StructField("affiliation_organization", T.ArrayType(T.StringType())),
    T.StructField("affiliation_tag_country", T.StringType()),
])
CORPUS_SCHEMA = T.StructType([
    T.StructField("eid", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("datesort", T.TimestampNTZType()),
    T.StructField("publication_type", T.StringType()),
    T.StructField("source", T.StructType([T.StructField("srcid", T.LongType())])),
    T.StructField("references", T.ArrayType(T.LongType())),
    T.StructField("au", T.ArrayType(_AU)),
    T.StructField("au_af", T.ArrayType(_AU_AF)),
    T.StructField("af", T.ArrayType(_AF)),
])

REPORT_CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def corpus_path(base: str, version: str, variant: str, table: str, stamp: str) -> str:
    return f"{base.rstrip('/')}/{version}/{variant}/{table}_{stamp}"


# The 2017 layout: two year columns, other names for the document type and the references.
CORPUS_2017_SCHEMA = T.StructType([
    T.StructField({"publication_type": "citation_type", "references": "citations", "year": "sort_year"}.get(f.name, f.name), f.dataType)
    for f in CORPUS_SCHEMA.fields
] + [T.StructField("pub_year", T.IntegerType())])
YEAR_COLUMNS = {"2019": ("year",), "2017": ("sort_year", "pub_year")}


def read_corpus(spark: SparkSession, base: str, version: str, variant: str = "full", stamp: str = "",
                table: str = "ani", *, layout: str = "2019", year_col: str | None = None) -> DataFrame:
    """Columnar corpus scan with the declared nested schema of its ``layout``, in the columns of
    ``CORPUS_SCHEMA`` (filters on year and nested column pruning reach the parquet reader; where the
    table is partitioned by year, see ``write_corpus``, they select folders).
    ``year_col`` chooses the year of the 2017 layout: ``sort_year`` (default) or ``pub_year``."""
    if layout not in YEAR_COLUMNS:
        raise ValueError(f"layout must be one of {sorted(YEAR_COLUMNS)}, not {layout!r}")
    year = year_col or YEAR_COLUMNS[layout][0]
    if year not in YEAR_COLUMNS[layout]:
        raise ValueError(f"the {layout} layout has no year column {year!r}")
    path = corpus_path(base, version, variant, table, stamp)
    if layout == "2019":
        return spark.read.schema(CORPUS_SCHEMA).parquet(path).select(*CORPUS_SCHEMA.names)
    names = {"year": year, "publication_type": "citation_type", "references": "citations"}
    return spark.read.schema(CORPUS_2017_SCHEMA).parquet(path).select(
        *[F.col(names.get(c, c)).alias(c) for c in CORPUS_SCHEMA.names])


def write_corpus(corpus: DataFrame, base: str, version: str, variant: str = "full", stamp: str = "", table: str = "ani",
                 rows_per_file: int = 5_000_000) -> str:
    """Write ``corpus`` where ``read_corpus`` finds it, partitioned by year: a folder for each year, so year
    bounds select folders (PartitionFilters) and a join on a few years prunes at run time. Rows
    are range-partitioned by (year, eid), so a year spans the tasks it needs and each task
    writes few files. Returns the path."""
    path = corpus_path(base, version, variant, table, stamp)
    rows = corpus.select(*CORPUS_SCHEMA.names).repartitionByRange("year", "eid")
    rows.write.option("maxRecordsPerFile", rows_per_file).partitionBy("year").parquet(path)
    return path


def only_years(corpus: DataFrame, years: DataFrame) -> DataFrame:
    """The papers of the years in the one-column frame ``years`` (an equi-join on the partition column:
    Spark reads only their folders, chosen at run time)."""
    y = years.select(F.col(years.columns[0]).cast("int").alias("_year")).distinct()
    return corpus.join(F.broadcast(y), corpus["year"] == y["_year"], "left_semi")  # at most one row per year


def read_table(spark: SparkSession, db: str, name: str) -> DataFrame:
    return spark.table(f"{db}.{name}")


def latest_table(spark: SparkSession, db: str, prefix: str) -> str:
    """Name of the newest dated snapshot ``<prefix>YYYYMMDD`` in ``db`` (catalog
    metadata only)."""
    pat = re.compile(re.escape(prefix) + r"\d{8}$")
    names = [t.name for t in spark.catalog.listTables(db) if pat.match(t.name)]
    if not names:
        raise LookupError(f"no table {prefix}YYYYMMDD in {db}")
    return max(names)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**REPORT_CSV_OPTIONS).csv(path)


def write_report(df: DataFrame, path: str, files: int = 1) -> None:
    """Small report as CSV with header, quoting and escaping (read back with the
    same options). ``files=1`` is meant for report-sized frames only."""
    df.coalesce(files).write.mode("overwrite").options(**REPORT_CSV_OPTIONS).csv(path)


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_fs(spark, path)
    return bool(fs.exists(p))


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Only on a local master, where driver
    and executors are one process, a temporary folder is made when it is unset; elsewhere
    that would leave each executor's part files on its own disk, so it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="scholarmetrics-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    return d.rstrip("/")


_SCRATCH: list[str] = []  # scratch folders made by this process
_TABLES: list[str] = []  # scratch tables of this process
_DATABASES: list[str] = []  # and scratch databases


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; ``release_scratch`` deletes it with all others of this process."""
    root = f"{shared_dir(spark)}/scholarmetrics/{uuid.uuid4().hex}"
    _SCRATCH.append(root)
    return f"{root}/{name}"


def scratch_database(spark: SparkSession) -> str:
    """A fresh catalog database in the shared folder, dropped by ``release_scratch``."""
    db = f"sm_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{scratch_path(spark, db)}'")
    _DATABASES.append(db)
    return db


def release_scratch(spark: SparkSession) -> int:
    """Delete this process's scratch folders (at the end of a run, when no frame reads them any
    more) and return their number. Stages stay: they are there to be reused."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _DATABASES:
        spark.sql(f"DROP DATABASE IF EXISTS {_DATABASES.pop()} CASCADE")
    done = 0
    while _SCRATCH:
        fs, p = _hadoop_fs(spark, _SCRATCH.pop())
        done += bool(fs.exists(p) and fs.delete(p, True))
    return done


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to scratch in the shared folder and read back with its own schema: every use sees
    the same rows and partition ids, and a lost executor re-reads instead of recomputing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """Buckets of the author tables: the session's shuffle partitions, so that aggregates by author line up."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _save_buckets(df: DataFrame, table: str, path: str, by: str, n: int, clustered: bool) -> None:
    rows = df if clustered else df.repartition(n, by)
    rows.write.mode("overwrite").bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(table)


def write_buckets(df: DataFrame, name: str, by: str, *, clustered: bool = False) -> DataFrame:
    """``df`` written to scratch as a table bucketed and sorted by ``by``: tables written so join on it
    without a shuffle. ``clustered``: the rows come out of an aggregate or join by ``by``, so
    each bucket's rows are in one partition already."""
    spark = df.sparkSession
    table = f"sm_{name}_{uuid.uuid4().hex}"
    _save_buckets(df, table, scratch_path(spark, name), by, bucket_count(spark), clustered)
    _TABLES.append(table)
    return spark.table(table)


# extra key component for a run that must not reuse earlier stages (the benchmark)
STAGE_NAMESPACE = ""


def input_fingerprint(spark: SparkSession, *paths: str) -> str:
    """(path, length, modification time) of every input file, via the Hadoop FS."""
    import hashlib

    h = hashlib.sha256()
    for path in paths:
        fs, p = _hadoop_fs(spark, path)
        for st in sorted(fs.listStatus(p), key=lambda x: x.getPath().toString()) if fs.getFileStatus(p).isDirectory() \
                else [fs.getFileStatus(p)]:
            h.update(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()};".encode())
    return h.hexdigest()[:16]


def code_version() -> str:
    """Hash of the library source (without the training-data operators, which no stage uses), so a
    staged result is never reused across code changes."""
    import hashlib
    import pathlib

    h = hashlib.sha256()
    root = pathlib.Path(__file__).resolve().parents[1]
    for f in sorted(root.rglob("*.py")):
        if "llm" not in f.relative_to(root).parts:
            h.update(f.read_bytes())
    return h.hexdigest()[:12]


SCHEMA_FILE = "_schema.json"  # next to a stage's files; readers skip names with an underscore


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _hadoop_fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop_fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def stage(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    name: str,
    key: str,
    base: str | None = None,
    *,
    by: str | None = None,
    files: int | None = None,
) -> DataFrame:
    """Materialise ``build()`` as parquet under (name, key) in the shared folder and
    read it back with the schema it was written with; reuse an earlier complete write
    (``_SUCCESS`` present). Cuts the lineage, so a lost executor does not recompute the
    upstream stages, and lets several reports share one computation.

    ``files``: write that many files, dealt round-robin. ``by``: write a table bucketed and
    sorted by that column (``write_buckets``), so that stages of the same ``by`` join without
    a shuffle; the number of buckets is part of the key."""
    import hashlib
    import json

    if by is not None and files is not None:
        raise ValueError("a bucketed stage has the files of its buckets")
    n = bucket_count(spark) if by else 0
    k = hashlib.sha256(f"{key}|{code_version()}|{STAGE_NAMESPACE}|{by}|{n}|{files}".encode()).hexdigest()[:16]
    root = (base or f"{shared_dir(spark)}/scholarmetrics/stages").rstrip("/")
    path, table = f"{root}/{name}_{k}", f"sm_stage_{name}_{k}"
    if not path_exists(spark, f"{path}/{SCHEMA_FILE}") or not path_exists(spark, f"{path}/_SUCCESS"):
        df = build()
        if by:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            _save_buckets(df, table, path, by, n, clustered=False)
        else:
            (df if files is None else df.repartition(files)).write.mode("overwrite").parquet(path)
        _write_text(spark, f"{path}/{SCHEMA_FILE}", df.schema.json())
    if by:
        if not spark.catalog.tableExists(table):  # written by an earlier session
            schema = T.StructType.fromJson(json.loads(_read_text(spark, f"{path}/{SCHEMA_FILE}")))
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
        return spark.table(table)
    return spark.read.schema(T.StructType.fromJson(json.loads(_read_text(spark, f"{path}/{SCHEMA_FILE}")))).parquet(path)


STAGE_KEY = "scholarmetrics.stage.key"


def drop_stage_tables(spark: SparkSession, db: str, names: list[str]) -> None:
    """Start of a run that must rebuild its catalog stages."""
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {db}.{n}")


def stage_table(spark: SparkSession, build: Callable[[], DataFrame], db: str, name: str, key: str) -> DataFrame:
    """Stage as a catalog table under ``key`` (parameters and input fingerprint), kept with the code
    version in a table property: built (saveAsTable) if absent or of another key, then read
    through the catalog."""
    full, own = f"{db}.{name}", f"{key}|{code_version()}"
    if spark.catalog.tableExists(full):
        found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {full}").collect()}
        if found.get(STAGE_KEY) == own:
            return spark.table(full)
    build().write.mode("overwrite").saveAsTable(full)
    spark.sql(f"ALTER TABLE {full} SET TBLPROPERTIES ('{STAGE_KEY}' = '{own}')")
    return spark.table(full)
