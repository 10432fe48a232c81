"""Files in and out: CSV, JSON lines, raw pages with sidecars, shards and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or a pattern of paths) is there, on whatever file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, columns: list[str], strict: bool = False) -> DataFrame:
    """All cells as strings, missing ones empty; the region ``NA`` stays a value. A missing file gives no rows, or with ``strict`` an error.

    A byte order mark before the first name is dropped; columns not in the file are null.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    raw = spark.read.csv(path, header=True, mode="FAILFAST" if strict else "PERMISSIVE", multiLine=True, escape='"')
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, bad: str = "fail") -> DataFrame:
    """JSON lines of a fixed schema; blank lines are skipped. ``bad`` lines fail, are dropped, or stay in ``_corrupt``."""
    if bad == "keep":
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        return spark.read.schema(T.StructType([*fields, T.StructField("_corrupt", T.StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return spark.read.schema(schema).json(path, mode={"fail": "FAILFAST", "drop": "DROPMALFORMED"}[bad])


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON document a file."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path, multiLine=True)


def read_shards(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "shard*", good: str | None = None) -> DataFrame:
    """All shards of a folder, with ``shard`` from the name of the file or of its folder; of the rows those whose column ``good`` is true."""
    df = read_jsonl(spark, f"{folder.rstrip('/')}/{pattern}", schema)
    df = df.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"shard[=_](\d+)", 1).cast("int"))
    return df.where(F.col(good)) if good else df


def read_conditions(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.jsonl") -> DataFrame:
    """Files below one folder a condition, with ``condition`` from the folder's name."""
    df = read_jsonl(spark, f"{folder.rstrip('/')}/*/{pattern}", schema)
    return df.withColumn("condition", F.try_url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/(?:condition=)?([^/]+)/[^/]+$", 1)))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Raw html and pdf files below region/institution, folders beginning with ``_`` left out.

    Columns: region, institution_id, stem, extension, sha256, size_bytes, content.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,pdf}").load(folder)
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.([a-z]+)$", k)
    return raw.where(~F.col("path").rlike(r"/_[^/]*/")).select(part(1).alias("region"), part(2).alias("institution_id"), part(3).alias("stem"), part(4).alias("extension"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), "content")


def read_sidecars(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The JSON beside each archived file, with ``stem``; unreadable ones drop out."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder, multiLine=True, mode="DROPMALFORMED")
    return df.withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def decode_pages(df: DataFrame, content: str = "content", out: str = "html") -> DataFrame:
    """Bytes to text by the charset the page names in its first 4096 bytes; unknown charsets count as utf-8, bad bytes are replaced."""

    @F.pandas_udf("string")
    def decode(raw):
        import codecs
        import re

        import pandas as pd

        def one(x):
            if x is None:
                return None
            m = re.search(rb"<meta[^>]+charset=[\"']?([A-Za-z0-9_-]+)", x[:4096], re.I)
            name = m.group(1).decode("ascii").lower() if m else "utf-8"
            try:
                codecs.lookup(name)
            except LookupError:
                name = "utf-8"
            return bytes(x).decode(name, "replace")

        return pd.Series([one(x) for x in raw])

    return df.withColumn(out, decode(F.col(content)))


def pdf_text(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``text``, ``n_pages`` and ``warning``: pages joined by blank lines; without a pdf reader empty text and a warning."""

    @F.pandas_udf("text string, n_pages int, warning string")
    def read(raw):
        import pandas as pd

        try:
            import fitz
        except ImportError:
            return pd.DataFrame({"text": [""] * len(raw), "n_pages": [0] * len(raw), "warning": ["no pdf reader"] * len(raw)})
        rows = []
        for x in raw:
            try:
                with fitz.open(stream=bytes(x), filetype="pdf") as doc:
                    pages = [p.get_text() for p in doc]
                rows.append(("\n\n".join(pages), len(pages), None))
            except Exception as e:
                rows.append(("", 0, type(e).__name__))
        return pd.DataFrame(rows, columns=["text", "n_pages", "warning"])

    return df.withColumn("pdf_", read(F.col(content))).select(*df.columns, "pdf_.*")


# --- sinks ------------------------------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """One CSV folder with header, null as an empty cell, quotes only where needed; ``columns`` sets the order.

    For reports: they are small, and become one file.
    """
    columns = columns or df.columns
    df.select(*[F.col(c).cast("string") if c in df.columns else F.lit("").alias(c) for c in columns]).coalesce(1).write.mode(mode).csv(path, header=True, nullValue="", emptyValue="", escape='"')


def append_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows added to a CSV folder; only the first part ever written has the header."""
    new = not exists(df.sparkSession, path)
    df.select(*[F.col(c).cast("string") if c in df.columns else F.lit("").alias(c) for c in columns]).coalesce(1).write.mode("append").csv(path, header=new, nullValue="", emptyValue="", escape='"')


def read_appended_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """What ``append_csv`` wrote, all cells as strings; the one header row drops out."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=False, multiLine=True, escape='"')
    header = F.struct(*[F.col(f"`{c}`") for c in columns]) == F.struct(*map(F.lit, columns))
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns]).where(~header)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The rows of a report as one JSON document with a key a line, letters as they are; nulls are kept. A report is small: it is put together by one task."""
    whole = df.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("rows"))
    whole.select(F.to_json("rows", {"pretty": "true", "ignoreNullFields": "false"})).coalesce(1).write.mode(mode).text(path)


def publish(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write a table beside its place, move it there in one step, and leave a manifest next to it, which is the result.

    Readers see the old table or the new one, never a part of it.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, place, old = hadoop.Path(f"{path}.new"), hadoop.Path(path), hadoop.Path(f"{path}.old")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(place):
        fs.rename(place, old)
    if not fs.rename(new, place):
        raise OSError(f"cannot publish {path}")
    fs.delete(old, True)
    manifest(spark.read.parquet(path), key).write.mode("overwrite").json(f"{path}.manifest")
    return spark.read.schema("n_rows bigint, n_keys bigint, digest string").json(f"{path}.manifest")


SIDECAR = "url string, accessed_at string, content_type string, extension string, size_bytes bigint, sha256 string, language_primary string, language_secondary string, country_code string, tier string, file string"


def write_archive(pages: DataFrame, folder: str, mode: str = "append") -> None:
    """Fetched pages as an archive: contents, sidecars and an index, each by region and institution.

    ``pages`` has institution_id, region, url, accessed_at (timestamp),
    content_type and content (binary); other columns of a sidecar are empty
    where they are missing. A file is named by its time and kind.
    """
    ext = F.when(F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("application/pdf")), "pdf").otherwise("html")
    at = F.date_format("accessed_at", "yyyyMMdd'T'HHmmss'Z'")
    some = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in pages.columns else F.lit("")).alias(c)
    rows = pages.select(
        F.coalesce("region", F.lit("")).alias("region"), F.coalesce("institution_id", F.lit("")).alias("institution_id"), "url", at.alias("accessed_at"), "content_type", ext.alias("extension"), F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"), some("language_primary"), some("language_secondary"), some("country_code"), some("tier"), F.concat_ws(".", at, ext).alias("file"), "content",
    )
    by = ["region", "institution_id"]
    rows.select(*by, "file", "sha256", "content").write.mode(mode).partitionBy(*by).parquet(f"{folder}/contents")
    rows.drop("content").write.mode(mode).partitionBy(*by).json(f"{folder}/sidecars")
    rows.select(*by, "file", "url", "sha256", "accessed_at").write.mode(mode).partitionBy(*by).json(f"{folder}/index")


def union_columns(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the first one's columns and then all others, sorted; what a frame lacks is null."""
    first = frames[0].columns
    extra = sorted({c for f in frames[1:] for c in f.columns} - set(first))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*first, *extra)


def write_shards(df: DataFrame, path: str, shard: Column, mode: str = "overwrite") -> None:
    """JSON lines in one folder a shard."""
    df.withColumn("shard", shard).repartition("shard").write.mode(mode).partitionBy("shard").json(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The column ``line`` in the order of ``line_no`` as one text file; for reports."""
    df.orderBy("line_no").select("line").coalesce(1).write.mode(mode).text(path)


def manifest(df: DataFrame, key: str) -> DataFrame:
    """One row: the number of rows and a hash of all of them, whatever their order.

    Rows are hashed where they are, and the hashes summed as exact decimals.
    """
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def column_drift(df: DataFrame, required: list[str]) -> tuple[list[str], list[str]]:
    """Required columns that are missing, and columns beyond them, both sorted."""
    return sorted(set(required) - set(df.columns)), sorted(set(df.columns) - set(required))
