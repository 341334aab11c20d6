"""Readers and writers of files: markdown, manifests, JSON lines, tables with schema migration."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvia.functions.markdown import junk_path
from corvia.functions.text import safe_relative_path
from corvia.operators.state import NotFound
from corvia.schemas import migration

#: Bytes of a document at most.
MOST_BYTES = 10 * 1024 * 1024


def open_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table, never created by reading; with a schema, missing numbers are 0 and orphan columns stay."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        raise NotFound(path) from e
    if schema is None:
        return table
    add, _ = migration(T.StructType([T.StructField(f.name, f.dataType) for f in table.schema]), T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    return table.withColumns({c: F.lit(0).cast(schema[c].dataType) for c in add}) if add else table


def open_or_create(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return open_table(spark, path, schema)
    except NotFound:
        spark.createDataFrame([], schema).write.parquet(path)
        return open_table(spark, path, schema)


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of markdown files below a folder that are no junk, not empty, and UTF-8."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").load(path)
    wanted = found.where((F.col("length") > 0) & (F.col("length") <= MOST_BYTES) & ~junk_path(F.col("path")))
    return wanted.select("path", F.col("content").cast("string").alias("text")).where(F.is_valid_utf8("text"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def yaml_files(spark: SparkSession, path: str, below: str = "Sub") -> DataFrame:
    """(path, text) of YAML files in folders of that name, whatever its case, at any depth."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yaml,yml}").load(path)
    inside = F.col("path").rlike(f"(?i)/{below}/")
    return found.where(inside & (F.col("length") <= MOST_BYTES)).select("path", F.col("content").cast("string").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; a line that is none stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of lines that are no JSON object."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value")
    return lines.where((F.trim("value") != "") & ~F.coalesce(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull(), F.lit(False)))


def manifest(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(line, path) of a list of paths, first occurrence only, without blanks and comments; and the lines that are wrong.

    A manifest is one file of one run, so it is numbered in one task.
    """
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "path"))
    rows = raw.select(F.col("line") + 1, F.trim("path").alias("path")).toDF("line", "path").where((F.col("path") != "") & ~F.col("path").startswith("#"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where("_n = 1").drop("_n")
    good = F.col("path").rlike(r"(?i)\.(md|markdown)$")
    listed = first.where(good).orderBy("line")
    return (listed.limit(limit) if limit else listed), first.where(~good)


def retrieve(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of distinct ids in the order asked for (ord), and the ids with a problem.

    ids: (document_id, ord). A problem is an unsafe, an unknown or an empty document.
    """
    asked = ids.groupBy("document_id").agg(F.min("ord").alias("ord"))
    joined = asked.join(documents, "document_id", "left")
    problem = F.when(~safe_relative_path(F.col("document_id")), "unsafe").when(F.col("content").isNull(), "missing").when(F.trim("content") == "", "empty")
    judged = joined.withColumn("problem", problem)
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null").select("document_id", "problem")


def shallow(text: Column, most: int = 80) -> Column:
    """The first lines of a page, up to a heading of examples; a summary's input, not a filter."""
    some = F.slice(F.split(text, "\n"), 1, most)
    stop = F.get(F.filter(F.transform(some, lambda x, i: F.when(x.rlike(r"(?i)^#+\s.*(示例|example)"), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.array_join(F.when(stop.isNull(), some).otherwise(F.slice(some, 1, F.greatest(stop, F.lit(0)))), "\n")


def write_snapshot(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace a table, or with ``by`` only the partitions (scopes) that df has rows of; a failed job leaves it as it was."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# YAML packages as files, manifests of runs, roots and names


def as_yaml(package: Column) -> Column:
    """JSON packages as YAML, keys in their order, other scripts as they are."""

    @F.pandas_udf("string")
    def dumped(values: pd.Series) -> pd.Series:
        import yaml

        return values.map(lambda v: None if v is None else yaml.safe_dump(json.loads(v), allow_unicode=True, sort_keys=False, width=1 << 20))

    return dumped(package)


def round_trips(package: Column, text: Column) -> Column:
    """Whether YAML text holds just what the JSON package does; a key that occurs twice, or another type, is none."""

    @F.pandas_udf("boolean")
    def same(packages: pd.Series, texts: pd.Series) -> pd.Series:
        from corvia.sources.api_documents import load_unique

        def one(p, t):
            try:
                return load_unique(t) == [json.loads(p)]
            except Exception:  # what can't be read doesn't hold it
                return False

        return pd.Series([p is not None and t is not None and one(p, t) for p, t in zip(packages, texts, strict=True)])

    return same(package, text)


def write_files(df: DataFrame, root: str, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, bytes, error): each row's text as a file of its own below root, complete or not there at all.

    A file is written under a name of its own beside its place and then renamed, by the task that has the row, through
    the file system of the root (``places``). Unsafe paths are errors. For packages of a run, not for tables.
    """

    def of(parts):
        from corvia.sources import places

        fs, folder = places.at(root)
        for part in parts:
            out = []
            for path, text in zip(part["path"], part["text"], strict=True):
                try:
                    if path is None or text is None or path.startswith("/") or ".." in path.split("/") or not path:
                        raise ValueError("unsafe path" if text is not None else "no text")
                    content = text.encode()
                    places.put(fs, f"{folder}/{path}", content)
                    out.append((path, len(content), None))
                except (OSError, ValueError) as e:
                    out.append((path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "bytes", "error"])

    return df.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInPandas(of, "path string, bytes long, error string")


def pending_manifest(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """(path): candidates (path, content_hash) that no finished output (path, content_hash) is of."""
    return candidates.select("path", "content_hash").distinct().join(done.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti").select("path").orderBy("path")


def completed(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Outputs (path, schema_version, content_hash, issues) with done: of this schema, without issues, of the source as
    it is now (path, text)."""
    now = sources.select("path", F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("_now"))
    fine = (F.col("schema_version") == "2.1") & (F.size(F.coalesce("issues", F.array().cast("array<string>"))) == 0) & (F.col("content_hash") == F.col("_now"))
    return outputs.join(now, "path", "left").withColumn("done", F.coalesce(fine, F.lit(False))).drop("_now")


def under_roots(path: Column, roots: list[str]) -> Column:
    """Whether a path lies below one of the roots that are allowed; dots that lead out are not followed."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | path.startswith(root.rstrip("/") + "/")
    return F.coalesce(inside & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


class Aliases:
    """Names of collections: a logical name stands for a table's path; a name of its own is looked up as such."""

    def __init__(self, aliases: dict[str, str], default: str | None = None):
        self.aliases, self.default = dict(aliases), default

    def resolve(self, name: str | None) -> str:
        wanted = name or self.default
        if wanted in self.aliases:
            return self.aliases[wanted]
        if wanted in self.aliases.values():
            return wanted
        raise KeyError(f"no collection {wanted}; there are {sorted(self.aliases)}")


def keys_with_prefix(values: DataFrame, prefix: str) -> DataFrame:
    """Rows (key, ...) whose key begins with a prefix, by key; a prefix is text, not a pattern."""
    return values.where(F.col("key").startswith(F.lit(prefix))).orderBy("key")


def summaries(documents: DataFrame, model: Column | None = None) -> DataFrame:
    """(filename, module, summary, apis) of markdown documents (path, text): the model's summary if there is one, else
    the first heading and paragraph."""
    from corvia.functions.markdown import signatures_column

    first = F.trim(F.regexp_replace(shallow(F.col("text"), 12), r"(?m)^#+\s*|\s+", " "))
    short = F.substring(first, 1, 200)
    return documents.select(F.substring_index("path", "/", -1).alias("filename"), F.get(F.reverse(F.split("path", "/")), F.lit(1)).alias("module"), F.coalesce(F.nullif(F.trim(model), F.lit("")), short).alias("summary") if model is not None else short.alias("summary"), signatures_column(F.col("text")).alias("apis"))
