"""Table sources and sinks: CSV with strict inference, Parquet, JDBC, snapshots, checksums, versions, scores."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of a missing value in text files.
NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_text_table(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV, TSV or TXT; each column is bigint, else double, else string, by all its values; Yes/No stays text."""
    raw = spark.read.csv(path, sep=sep, header=header, inferSchema=False, quote='"', escape='"')
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(*NULLS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if not raw.columns:
        return clean
    counts = clean.agg(*[x for i, c in enumerate(clean.columns) for x in (F.count(f"`{c}`").alias(f"n{i}"), F.count(F.expr(f"try_cast(`{c}` as bigint)")).alias(f"i{i}"), F.count(F.expr(f"try_cast(`{c}` as double)")).alias(f"d{i}"))]).first()
    kinds = ["bigint" if counts[f"n{i}"] == counts[f"i{i}"] and counts[f"n{i}"] else "double" if counts[f"n{i}"] == counts[f"d{i}"] and counts[f"n{i}"] else "string" for i in range(len(clean.columns))]
    return clean.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(clean.columns, kinds, strict=True)])


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 32, properties: dict | None = None) -> DataFrame:
    """A database table, read in ranges of a numeric column if one is given."""
    reader = spark.read.format("jdbc").options(url=url, **(properties or {}))
    if column is None:
        return reader.option("dbtable", table).load()
    mark = "`" if url.startswith("jdbc:mysql") else '"'
    key = f"{mark}{column}{mark}"
    low, high = reader.option("query", f"select min({key}) as lo, max({key}) as hi from {table}").load().first()
    return spark.read.format("jdbc").options(url=url, **(properties or {}), dbtable=table, partitionColumn=column, lowerBound=str(low or 0), upperBound=str(high or 0), numPartitions=str(parts)).load()


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class DatabaseTable:
    """What a database tells of a table: columns with their SQL type numbers, the primary key, the foreign keys."""

    name: str
    columns: tuple[tuple[str, int], ...]
    key: tuple[str, ...]
    foreign: tuple[ForeignKey, ...]


#: java.sql.Types of whole numbers, by which a scan can be split.
WHOLE = (-6, 5, 4, -5)


@contextmanager
def database(spark: SparkSession, url: str, properties: dict | None = None) -> Iterator:
    """A JDBC connection of the driver, for metadata; rows are read by executors."""
    jvm, given = spark._jvm, dict(properties or {})
    if "driver" in given:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(given.pop("driver"))
    told = jvm.java.util.Properties()
    for k, v in given.items():
        told.setProperty(k, str(v))
    connection = jvm.java.sql.DriverManager.getConnection(url, told)
    try:
        yield connection
    finally:
        connection.close()


def _rows(found, *names: str) -> list[tuple]:
    """The named columns of a result set, which is closed."""
    out = []
    while found.next():
        out.append(tuple(found.getString(n) for n in names))
    found.close()
    return out


def catalog(spark: SparkSession, url: str, properties: dict | None = None, schema: str | None = None) -> dict[str, DatabaseTable]:
    """The tables of a database (of one schema, if given) by `schema.table`, with primary and foreign keys as the database has them."""
    out = {}
    with database(spark, url, properties) as connection:
        told, kinds = connection.getMetaData(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        full = lambda *parts: ".".join(p for p in parts if p)
        for cat, sch, table in _rows(told.getTables(None, schema, "%", kinds), "TABLE_CAT", "TABLE_SCHEM", "TABLE_NAME"):
            columns = [(n, int(t)) for n, t, _ in sorted(_rows(told.getColumns(cat, sch, table, "%"), "COLUMN_NAME", "DATA_TYPE", "ORDINAL_POSITION"), key=lambda r: int(r[2]))]
            key = [n for n, _ in sorted(_rows(told.getPrimaryKeys(cat, sch, table), "COLUMN_NAME", "KEY_SEQ"), key=lambda r: int(r[1]))]
            edges: dict[tuple, list] = {}
            for name, ps, pt, pc, fc, seq in _rows(told.getImportedKeys(cat, sch, table), "FK_NAME", "PKTABLE_SCHEM", "PKTABLE_NAME", "PKCOLUMN_NAME", "FKCOLUMN_NAME", "KEY_SEQ"):
                edges.setdefault((name, full(ps, pt)), []).append((int(seq), fc, pc))
            foreign = [ForeignKey(tuple(f for _, f, _ in sorted(e)), parent, tuple(p for _, _, p in sorted(e))) for (_, parent), e in sorted(edges.items(), key=str)]
            out[full(sch, table)] = DatabaseTable(full(sch, table), tuple(columns), tuple(key), tuple(foreign))
    return out


def read_catalog(spark: SparkSession, url: str, properties: dict | None = None, schema: str | None = None, parts: int = 32) -> dict[str, DataFrame]:
    """Every table of a database as a DataFrame, scanned in ranges of the first whole-number column of its primary key."""
    mark = "`" if url.startswith("jdbc:mysql") else '"'
    out = {}
    for name, t in catalog(spark, url, properties, schema).items():
        kinds = dict(t.columns)
        column = next((c for c in t.key if kinds[c] in WHOLE), None)
        quoted = ".".join(f"{mark}{p}{mark}" for p in name.split("."))
        out[name] = read_jdbc(spark, url, quoted, column, parts, properties)
    return out


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """df, if it has at most `limit` rows; a longer result is an error and is never cut short."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"the result has more than {limit} rows")
    return df


def select_import(spark: SparkSession, query: str, limit: int = 100_000) -> DataFrame:
    """The result of one SELECT, of at most `limit` rows."""
    if not query.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only a SELECT can be imported")
    return bounded(spark.sql(query), limit)


def checksum(df: DataFrame) -> Column:
    """An aggregate: the sum over rows of the low 64 bits of the md5 of the row's text; order does not matter, repeats do."""
    fields = F.concat_ws(chr(31), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(chr(0))) for c in df.columns])
    return F.sum(F.conv(F.substring(F.md5(fields.cast("binary")), 17, 16), 16, 10).cast("decimal(38,0)"))


def table_record(df: DataFrame, time: str | None) -> DataFrame:
    """One row: rows, max_time, null_time_rows, checksum."""
    t = F.col(time) if time else F.lit(None).cast("timestamp_ntz")
    return df.agg(F.count("*").alias("n_rows"), F.max(t).alias("max_time"), (F.count_if(t.isNull()) if time else F.lit(0).cast("long")).alias("null_time_rows"), checksum(df).alias("checksum"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count and the exclusive-or (16 hex digits, null without rows) of the low 64 bits of the md5 of each row's text; a null is told from its place."""
    fields = F.concat_ws(chr(31), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(chr(0))) for c in df.columns])
    digest = F.md5(fields.cast("binary"))
    half = lambda at: F.lpad(F.lower(F.hex(F.bit_xor(F.conv(F.substring(digest, at, 8), 16, 10).cast("long")))), 8, "0")
    return df.agg(F.count("*").alias("n_rows"), F.concat(half(17), half(25)).alias("hash"))


def as_of(df: DataFrame, time: str | None, when: str, columns: list[str] | None = None) -> DataFrame:
    """Rows up to and with `when` (static tables whole) and the chosen columns, the time always among them."""
    names = df.columns if columns is None else list(dict.fromkeys([*columns, *([time] if time else [])]))
    out = df.select(*names)
    return out.where(F.col(time) <= F.lit(when).cast("timestamp_ntz")) if time else out


@dataclass(frozen=True)
class Record:
    table: str
    columns: tuple[str, ...]
    n_rows: int
    max_time: str | None
    null_time_rows: int
    checksum: str


def version_id(records: list[Record], scope: str = "") -> str:
    """SHA-256 over the sorted records: the same data give the same id."""
    return hashlib.sha256(json.dumps([scope, *[asdict(r) for r in sorted(records, key=lambda r: r.table)]], sort_keys=True).encode()).hexdigest()


def snapshot(spark: SparkSession, tables: dict[str, tuple[DataFrame, str | None]], when: str, root: str, columns: dict[str, list[str]] | None = None) -> tuple[str, str]:
    """(version id, folder). All tables are written under a temporary name, checked, and renamed together; one failure leaves nothing."""
    work = f"{root.rstrip('/')}/_tmp-{hashlib.sha256(when.encode()).hexdigest()[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(work)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    records = []
    try:
        for name, (df, time) in tables.items():
            part = as_of(df, time, when, (columns or {}).get(name))
            part.write.mode("overwrite").parquet(f"{work}/{name}")
            copy = spark.read.parquet(f"{work}/{name}")
            if time and copy.where(F.col(time) > F.lit(when).cast("timestamp_ntz")).take(1):
                raise RuntimeError(f"{name}: a row is later than {when}")
            r = table_record(copy, time).first()
            records.append(Record(name, tuple(copy.columns), r["n_rows"], str(r["max_time"]) if r["max_time"] else None, r["null_time_rows"], str(r["checksum"])))
    except BaseException:
        fs.delete(at, True)
        raise
    version = version_id(records, when)
    to = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{version}")
    if fs.exists(to):
        fs.delete(at, True)
    else:
        fs.rename(at, to)
    return version, f"{root.rstrip('/')}/{version}"


def store_version(df: DataFrame, root: str) -> str:
    """The folder of a content-addressed copy: the same rows give the same folder, written once."""
    value = df.agg(checksum(df)).first()[0]
    path = f"{root.rstrip('/')}/{hashlib.sha256(json.dumps([str(value), df.columns]).encode()).hexdigest()}"
    df.write.mode("ignore").parquet(path)
    return path


def cached_features(spark: SparkSession, root: str, features: list, version: str, spine: DataFrame, make) -> DataFrame:
    """make(), written once for the same features, data version and label rows; a failure is not kept."""
    rows = spine.agg(checksum(spine.select("entity_id", "cutoff_time"))).first()[0]
    key = hashlib.sha256(json.dumps([repr(f) for f in features] + [version, str(rows)]).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{key}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def typed_time(df: DataFrame, column: str) -> DataFrame:
    """A text column as a time; text that is no time is an error that names the column."""
    new = F.expr(f"try_to_timestamp(`{column}`)").cast("timestamp_ntz")
    if df.where(F.col(column).isNotNull() & new.isNull()).take(1):
        raise ValueError(f"{column}: not a date or time")
    return df.withColumn(column, new)


def write_scores_csv(scores: DataFrame, root: str, cutoff: str) -> str:
    """One CSV folder for each cutoff, ranked; the list of entities is small beside the data it comes from."""
    path = f"{root.rstrip('/')}/scores-{cutoff[:10]}"
    scores.orderBy("rank").write.mode("overwrite").csv(path, header=True)
    return path


def append_history(row: DataFrame, path: str) -> None:
    """Append a scoring's record (cutoff, rows, hash, PSI by feature, drifted list)."""
    row.write.mode("append").parquet(path)


def write_back(scores: DataFrame, run_id: str, url: str | None = None, table: str = "tidemark_scores", path: str | None = None, properties: dict | None = None) -> None:
    """Insert run_id, entity_id, cutoff_time, score, created_at, into a database table or a Parquet folder."""
    rows = scores.select(F.lit(run_id).alias("run_id"), "entity_id", "cutoff_time", "score", F.current_timestamp().alias("created_at"))
    if url:
        rows.write.mode("append").jdbc(url, table, properties=properties)
    else:
        rows.write.mode("append").parquet(path)
