"""Readers: delimited text, JSON, plain text, files as rows, JDBC and stream options."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import missing as M
from ..functions.text import clean_names, line_count

CORRUPT = "_corrupt_record"
#: Formats by MIME type, encodings and delimiters in the order they are tried.
MIME = {
    "text/csv": "csv",
    "application/csv": "csv",
    "application/json": "json",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-excel": "xls",
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/msword": "doc",
    "text/plain": "txt",
    "text/markdown": "md",
    "application/rtf": "rtf",
    "image/png": "png",
    "image/jpeg": "jpg",
    "image/jpg": "jpg",
    "image/gif": "gif",
    "image/webp": "webp",
}
ENCODINGS = ("UTF-8", "ISO-8859-1")
DELIMITERS = (",", "\t", ";", "|")


def read_csv(spark: SparkSession, path, schema: str | T.StructType | None = None, delimiter: str = ",", encoding: str = "UTF-8", header: bool = True, null_value: str = "", bad_lines: str = "keep", **options) -> DataFrame:
    """Delimited files.  Malformed lines stay in _corrupt_record (keep) or go (drop).

    Without a schema the columns' types are inferred, which reads the files once more.
    Lines to skip are marked by the comment option; a locale's decimal marks come through
    `options` too.
    """
    r = spark.read.option("sep", delimiter).option("encoding", encoding).option("header", header).option("nullValue", null_value).options(**options)
    if schema is None:
        schema = r.option("inferSchema", True).csv(path).schema
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if bad_lines == "drop":
        return r.schema(schema).option("mode", "DROPMALFORMED").csv(path)
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return r.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def is_broken(df: DataFrame):
    """True for malformed rows.  Names the other columns too: raw files can't be asked for this one alone."""
    others = [F.col(f"`{c}`") for c in df.columns if c != CORRUPT]
    return F.col(CORRUPT).isNotNull() & (F.hash(*others) >= -(1 << 31)) if others else F.col(CORRUPT).isNotNull()


def good_rows(df: DataFrame) -> DataFrame:
    return df.filter(~is_broken(df)).drop(CORRUPT) if CORRUPT in df.columns else df


def bad_row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(is_broken(df).cast("long")), F.lit(0)).alias("bad_rows"))


def sniff_delimiter(spark: SparkSession, path, sample_lines: int = 20) -> str:
    """The first candidate present in the first lines; a bounded sample."""
    lines = [r.value for r in spark.read.text(path).limit(sample_lines).collect()]
    head = "\n".join(lines)[:1000]
    return next((d for d in DELIMITERS if d in head), ",")


def sniff_encoding(spark: SparkSession, path, size: int = 8192) -> str:
    """UTF-8 if the head of every file is valid, else a single-byte encoding."""
    files = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size - 4).alias("head"))
    bad = files.filter(~F.is_valid_utf8(F.col("head").cast("string"))).limit(1).count()
    return ENCODINGS[1] if bad else ENCODINGS[0]


def page(df: DataFrame, order_cols: list[str], limit: int, offset: int = 0) -> DataFrame:
    if not order_cols:
        raise ValueError("paging needs order_cols")
    return df.orderBy(*order_cols).offset(offset).limit(limit)


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def infer_types(df: DataFrame, share: float = 1.0) -> DataFrame:
    """Text columns become integer, float, boolean or timestamp where all values (or a share) convert.

    One aggregate counts for every column and type.
    """
    cols = M.strings(df)
    kinds = ("bigint", "double", "boolean", "timestamp")
    if not cols:
        return df
    conv = lambda c, k: F.try_to_timestamp(F.col(c)) if k == "timestamp" else F.col(c).try_cast(k)
    row = df.agg(*[x for i, c in enumerate(cols) for x in (F.count(c).alias(f"n{i}"), *[F.count(conv(c, k)).alias(f"{k}{i}") for k in kinds])]).first()
    out = {}
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        k = next((k for k in kinds if n and row[f"{k}{i}"] >= share * n), None)
        if k:
            out[c] = conv(c, k)
    return df.withColumns(out) if out else df


def schema_profile(df: DataFrame, order_cols: list[str] | None = None, samples: int = 5) -> DataFrame:
    """column_name, logical_type, nullable, null_count, unique_count, samples (of a bounded head)."""
    from ..operators.profile import nulls_distinct

    flat = df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.StructType, T.MapType, T.ArrayType)) else F.col(c) for c in df.columns])
    p = nulls_distinct(flat)
    head = (flat.orderBy(*order_cols) if order_cols else flat).limit(100).agg(*[F.slice(F.collect_list(F.col(c).cast("string")), 1, samples).alias(f"samples__{i}") for i, c in enumerate(flat.columns)])
    s = M.long_rows(head, df.columns, {"samples": "array<string>"})
    kinds = df.sparkSession.createDataFrame([(f.name, M.logical_type(f.dataType)) for f in df.schema.fields], "column_name string, logical_type string")
    return p.select("column_name", (F.col("null_count") > 0).alias("nullable"), "null_count", "unique_count").join(F.broadcast(s), "column_name").join(F.broadcast(kinds), "column_name")  # a row per column


def read_json(spark: SparkSession, path, schema=None) -> DataFrame:
    """A list of records, or one object, per file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_jsonl(spark: SparkSession, path, schema: str | T.StructType | None = None) -> DataFrame:
    """One object per line; malformed lines stay in _corrupt_record."""
    if schema is None:
        found = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path).schema
        schema = T.StructType([f for f in found.fields if f.name != CORRUPT])
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def json_path_rows(df: DataFrame, column: str, path: str, schema: str) -> DataFrame:
    """The sub-documents a path of the form $.a.b[*] picks, one row each."""
    whole = path.removesuffix("[*]")
    d = df.withColumn("__x", F.from_json(F.get_json_object(F.col(column), whole), f"array<struct<{schema}>>" if path.endswith("[*]") else f"struct<{schema}>"))
    return d.withColumn("__x", F.explode("__x")).select("__x.*") if path.endswith("[*]") else d.select("__x.*")


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct fields become columns named by their path, at every depth."""

    def leaves(fields, path):
        for f in fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, at)
            else:
                yield F.col(".".join(f"`{p}`" for p in at)).alias(separator.join(at))

    return df.select(*leaves(df.schema.fields, []))


def arrays(df: DataFrame, column: str, how: str = "expand") -> DataFrame:
    """expand: a row per element (an empty list keeps one null row); join: text; first: one element."""
    if how == "expand":
        return df.withColumn(column, F.explode_outer(column))
    if how == "join":
        return df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), ", "))
    if how == "first":
        return df.withColumn(column, F.get(column, F.lit(0)))
    raise ValueError(f"unknown handling {how}")


def coerce_mixed(df: DataFrame, columns: list[str] | None = None, time_share: float = 0.5) -> DataFrame:
    """Text columns to numbers if all convert, to timestamps if more than half do."""
    cols = columns or M.strings(df)
    if not cols:
        return df
    row = df.agg(*[x for i, c in enumerate(cols) for x in (F.count(c).alias(f"n{i}"), F.count(F.col(c).try_cast("double")).alias(f"d{i}"), F.count(F.try_to_timestamp(F.col(c))).alias(f"t{i}"))]).first()
    out = {}
    for i, c in enumerate(cols):
        n, d, t = (row[f"{k}{i}"] for k in "ndt")
        if n and d == n:
            out[c] = F.col(c).try_cast("double")
        elif n and t > time_share * n:
            out[c] = F.try_to_timestamp(F.col(c))
    return df.withColumns(out) if out else df


def record_dict_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """key and fields of every entry of an object of objects."""
    return df.select(F.explode(F.from_json(F.col(column), f"map<string,struct<{schema}>>")).alias("key", "__v")).select("key", "__v.*")


def json_shape(text: str, spark: SparkSession) -> str:
    """array, object_of_objects, object_of_arrays, object or primitive, of a sample text."""
    kind = T._parse_datatype_string(spark.range(1).select(F.schema_of_json(F.lit(text)).alias("s")).first().s.replace("STRUCT<", "struct<"))
    if isinstance(kind, T.ArrayType):
        return "array"
    if not isinstance(kind, T.StructType):
        return "primitive"
    kinds = [f.dataType for f in kind.fields]
    if len(kinds) > 1 and all(isinstance(k, T.StructType) for k in kinds):
        return "object_of_objects"
    return "object_of_arrays" if kinds and all(isinstance(k, T.ArrayType) for k in kinds) else "object"


def sheet_union(sheets: dict[str, DataFrame]) -> DataFrame:
    from ..operators.ordering import union_all

    return union_all([d.withColumn("_sheet", F.lit(n)) for n, d in sheets.items()])


def text_lines(spark: SparkSession, path) -> DataFrame:
    """file_path, line_number (from 1), content of whole-text files."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    return d.select("file_path", F.posexplode(F.split("value", "\n")).alias("line_number", "content")).withColumn("line_number", F.col("line_number") + 1)


def text_counts(df: DataFrame, column: str = "value") -> DataFrame:
    c = F.col(column)
    return df.withColumns({"n_lines": line_count(c), "n_paragraphs": F.size(F.filter(F.split(c, r"\n\s*\n"), lambda x: F.trim(x) != "")).cast("long"), "n_chars": F.length(c).cast("long")})


def file_catalog(spark: SparkSession, path, mime: dict[str, str] | None = None) -> DataFrame:
    """path, modified, size, extension, format, fingerprint; contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return d.withColumns({"extension": ext, "format": F.when(ext == "", "unknown").otherwise(ext), "fingerprint": F.md5(F.concat_ws(":", "path", F.col("modified").cast("string"), F.col("size").cast("string")))})


def format_of(mime, extension):
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.element_at(table, mime), F.nullif(F.lower(extension), F.lit("")), F.lit("unknown"))


def unreadable(spark: SparkSession, paths: list[str], fmt: str, schema) -> list[str]:
    """Those of the files that a strict read fails on, found by halves: a list that reads well holds none."""
    if not paths:
        return []
    try:
        spark.read.option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False).schema(schema).format(fmt).load(paths).write.format("noop").mode("overwrite").save()
        return []
    except (PySparkException, Py4JJavaError) as e:
        if not any(x in str(e) for x in ("FAILED_READ_FILE", "PATH_NOT_FOUND")):
            raise
    if len(paths) == 1:
        return paths
    half = len(paths) // 2
    return [p for part in (paths[:half], paths[half:]) for p in unreadable(spark, part, fmt, schema)]


def resilient_load(spark: SparkSession, paths: list[str], catalog: DataFrame, fmt: str = "parquet", schema=None) -> tuple[DataFrame, DataFrame]:
    """(rows with file_path of what can be read, catalog rows of files that can't).

    Files that gave no row are read once more, strictly: one without rows hasn't failed.
    """
    r = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    found = (r.schema(schema) if schema else r).format(fmt).load(paths)
    rows = found.withColumn("file_path", F.col("_metadata.file_path"))
    silent = catalog.join(rows.select("file_path").distinct(), F.regexp_replace(catalog["path"], "^file:/+", "/") == F.regexp_replace(F.col("file_path"), "^file:/+", "/"), "left_anti")
    failed = unreadable(spark, [x.path for x in silent.select("path").distinct().collect()], fmt, found.schema)  # names of files
    return rows, catalog.join(F.broadcast(spark.createDataFrame([(p,) for p in failed], "path string")), "path", "left_semi")


def route_by_name(catalog: DataFrame, extensions: list[str]) -> DataFrame:
    """Files of the extensions, with the analysis their path asks for."""
    p = F.lower("path")
    kind = F.when(F.contains(p, F.lit("dashboard")), "dashboard").when(F.rlike(p, F.lit("chart|graph")), "chart").when(F.contains(p, F.lit("table")), "table").otherwise("chart")
    return catalog.filter(F.col("extension").isin(*[e.lower().lstrip(".") for e in extensions])).withColumn("analysis", kind)


def standardize_tables(tables: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """(table, source file, page) stacked: clean names, columns named like a date as timestamps."""
    from ..operators.ordering import union_all

    out = []
    for df, source, page_no in tables:
        df = clean_columns(df)
        dates = {c: F.try_to_timestamp(F.col(c)) for c in M.strings(df) if "date" in c}
        out.append((df.withColumns(dates) if dates else df).withColumns({"source_file": F.lit(source), "page": F.lit(page_no)}))
    return union_all(out)


def json_repair(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Texts parsed after trailing commas are dropped; what still fails keeps its text and an error."""
    fixed = F.regexp_replace(F.col(column), r",\s*([}\]])", "$1")
    kept = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(CORRUPT, T.StringType())])
    d = df.withColumn("__x", F.from_json(fixed, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("__x").isNull() | F.col(f"__x.{CORRUPT}").isNotNull()
    return d.select(*[c for c in df.columns if c != column], *[F.col(f"__x.{f.name}") for f in kept.fields[:-1]], F.when(bad, F.col(column)).alias("raw_content"), F.when(bad, F.lit("invalid json")).alias("error"))


def decode_text(df: DataFrame, column: str = "content") -> DataFrame:
    """text and encoding of binary contents: UTF-8 where valid, else a single-byte encoding."""
    good = F.is_valid_utf8(F.col(column).cast("string"))
    return df.withColumns({"text": F.when(good, F.decode(column, "UTF-8")).otherwise(F.decode(column, "ISO-8859-1")), "encoding": F.when(good, "utf-8").otherwise("latin-1")})


def csv_text_rows(df: DataFrame, column: str, schema: str, delimiter: str = ",") -> DataFrame:
    """Rows of delimited text lines, cells trimmed."""
    opts = {"sep": delimiter, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return df.withColumn("__x", F.from_csv(F.col(column), schema, opts)).select(*[c for c in df.columns if c != column], "__x.*")


def jdbc_options(host: str, port: int, database: str, kind: str = "postgresql", table: str | None = None, query: str | None = None, user: str | None = None, password: str | None = None, partition: tuple[str, int, int, int] | None = None) -> dict[str, str]:
    """Options of spark.read.jdbc; partition is (column, lower, upper, tasks)."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    out = {"url": f"jdbc:{kind}://{host}:{port}/{database}", "dbtable" if table else "query": table or query}
    out |= {k: v for k, v in (("user", user), ("password", password)) if v}
    if partition:
        out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition), strict=True))
    return out


def read_jdbc(spark: SparkSession, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**kw)).load()


def key_ranges(spark: SparkSession, url: str, table: str, key: str, tasks: int, properties: dict[str, str] | None = None) -> list[str]:
    """Predicates that cut a table at quantiles of a numeric key into ranges of about equally many rows; nulls go with the first.

    The keys alone are read, in parallel over even ranges, and sketched.
    """
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    read = spark.read.format("jdbc").options(url=url, **(properties or {}))
    lo, hi = read.option("dbtable", f"(SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {table}) ends").load().first()
    if lo is None or lo == hi or tasks < 2:
        return ["1 = 1"]
    even = read.options(dbtable=f"(SELECT {name} FROM {table}) keys", partitionColumn=name, lowerBound=str(int(lo)), upperBound=str(int(hi) + 1), numPartitions=str(tasks))
    cuts = sorted(set(even.load().toDF("k").approxQuantile("k", [i / tasks for i in range(1, tasks)], 0.01)) - {float(lo)})
    texts = [str(int(c)) if c == int(c) else repr(c) for c in cuts]
    if not texts:
        return ["1 = 1"]
    middle = [f"{name} >= {a} AND {name} < {b}" for a, b in zip(texts, texts[1:], strict=False)]
    return [f"{name} < {texts[0]} OR {name} IS NULL", *middle, f"{name} >= {texts[-1]}"]


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, key: str, tasks: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """A table over JDBC, one task for each range of `key_ranges`; filters and columns go to the database."""
    return spark.read.jdbc(url, table, predicates=key_ranges(spark, url, table, key, tasks, properties), properties=properties or {})


def drop_embedded(spark: SparkSession, url: str) -> None:
    """Let an embedded in-memory database go."""
    try:
        spark._jvm.java.sql.DriverManager.getConnection(url + ";drop=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # how this driver says it is done
            raise


def file_stream(spark: SparkSession, path, schema, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def kafka_options(servers: str, topic: str, starting: str = "earliest", **extra) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, **extra}


def preview(df: DataFrame, order_cols: list[str], n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(one row with n_rows, n_columns, dtypes; the first n rows)."""
    facts = df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), F.create_map(*[F.lit(x) for kv in df.dtypes for x in kv]).alias("dtypes"))
    return facts, df.orderBy(*order_cols).limit(n)


def result_view(df: DataFrame, order_cols: list[str], column: str = "text", n: int = 10, size: int = 500) -> DataFrame:
    """The first n documents: preview, length, words and their meta_ fields."""
    from ..functions.text import word_count

    meta = [c for c in df.columns if c.startswith("meta_")]
    d = df.orderBy(*order_cols).limit(n)
    return d.select(*order_cols, F.left(F.col(column), F.lit(size)).alias("preview"), F.length(column).cast("long").alias("text_length"), word_count(F.col(column)).alias("words"), *meta)


def extract_documents(pages: DataFrame, drop_bodies: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows source_file, file_type, text_content, enhanced_content; one row of success and failure counts)."""
    from ..functions.text import strip_markup

    text = strip_markup(F.col("html"), drop_bodies)
    d = pages.select(F.col("page_id"), F.col("url").alias("source_file"), F.lit("html").alias("file_type"), text.alias("text_content"), text.alias("enhanced_content"))
    ok = F.coalesce(F.length("text_content") > 0, F.lit(False))
    return d, d.agg(F.sum(ok.cast("long")).alias("succeeded"), F.sum((~ok).cast("long")).alias("failed"))
