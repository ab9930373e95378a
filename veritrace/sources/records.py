"""Strict readers of labelled records: every row keeps its file and line, and what is wrong with it."""

from __future__ import annotations

import json
import re
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrace.functions.codec import collapsed, trimmed
from veritrace.runtime import file_system, materialize


def source_spec(spec: str) -> tuple[str, str]:
    """(name, path) of [NAME=]PATH; without a name the file's stem."""
    name, found, path = spec.partition("=")
    if not found:
        name, path = spec.rsplit("/", 1)[-1].rsplit(".", 1)[0], spec
    name = name.strip()
    if not name or not path:
        raise ValueError(f"no source name or path in {spec!r}")
    return name, path


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, ordinal, raw, value): the lines of JSONL files that aren't blank.

    line counts every line of a file from 1, ordinal those that aren't blank from 0; value is null where a line isn't JSON. Files
    are read in ranges, however large one is: lines are written once with the range they came from and their place in it, ranges of
    at most 65,536 lines are counted, and sums over the ranges before them give the numbers. No text is shuffled.
    """
    # how a file is split depends on the session, so the places are written with the lines, and read from there
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("raw"))
    lines = materialize(text.withColumn("part", F.shiftright("at", 16)), "lines")
    blank = trimmed(F.col("raw")) == ""
    parts = lines.groupBy("file", "block", "part").agg(
        F.min("at").alias("first"), F.count("*").alias("n"), F.count_if(blank).alias("blanks"), F.collect_list(F.when(blank, F.col("at"))).alias("blank_at")
    )
    before = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = parts.select("file", "block", "part", "first", zero("n").alias("lines_before"), (zero("n") - zero("blanks")).alias("kept_before"), "blank_at")
    k = F.col("at") - F.col("first")
    return (
        lines.filter(~blank).join(placed, ["file", "block", "part"])
        .select(
            "file", (F.col("lines_before") + k + 1).cast("int").alias("line"), (F.col("kept_before") + k - F.size(F.filter("blank_at", lambda b: b < F.col("at")))).cast("int").alias("ordinal"),
            "raw", F.try_parse_json("raw").alias("value"),
        )
    )


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """The same of files that hold one JSON array each; line is the element's number from 1. A file that isn't one gives no rows."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    each = F.try_variant_get("v", "$", "array<variant>")
    return text.select("file", F.posexplode(each).alias("k", "value")).select("file", (F.col("k") + 1).alias("line"), F.col("k").alias("ordinal"), F.to_json("value").alias("raw"), "value")


def records(spark: SparkSession, path: str) -> DataFrame:
    """jsonl or json_array by the suffix of the path."""
    return jsonl(spark, path) if path.lower().endswith(".jsonl") else json_array(spark, path)


def kind(value: Column) -> Column:
    """The type of a variant in one word: OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, DOUBLE, DECIMAL, VOID."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def record_error(value: Column, raw: Column) -> Column:
    """The first thing wrong with a raw labelled record, null if nothing is.

    not_json, not_object, missing_key, unknown_key, bad_content (neither a non-empty array nor a non-empty string),
    bad_label (not the integers 0 or 1; true isn't one), bad_reason (blank), bad_source (given but blank).
    """
    get = lambda p, t: F.try_variant_get(value, p, t)
    keys = F.json_object_keys(raw)
    content, reason, label, source = (get(f"$.{k}", "variant") for k in ("content", "reason", "label", "source"))
    is_array = (kind(content) == "ARRAY") & (F.size(get("$.content", "array<variant>")) > 0)
    is_text = (kind(content) == "STRING") & (trimmed(get("$.content", "string")) != "")
    has = lambda k: F.array_contains(keys, k)
    return (
        F.when(value.isNull(), "not_json")
        .when(kind(value) != "OBJECT", "not_object")
        .when(~(has("content") & has("label") & has("reason")), "missing_key")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, ("content", "label", "reason", "source"))))) > 0, "unknown_key")
        .when(~F.coalesce(is_array | is_text, F.lit(False)), "bad_content")
        .when(~F.coalesce((kind(label) == "BIGINT") & get("$.label", "bigint").isin(0, 1), F.lit(False)), "bad_label")
        .when(~F.coalesce((kind(reason) == "STRING") & (trimmed(get("$.reason", "string")) != ""), F.lit(False)), "bad_reason")
        .when(has("source") & ~F.coalesce((kind(source) == "STRING") & (trimmed(get("$.source", "string")) != ""), F.lit(False)), "bad_source")
    )


def labelled(rows: DataFrame, source: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(items, quarantine) of records(): typed rows that are right, and the rest with what is wrong."""
    judged = rows.withColumn("error", record_error(F.col("value"), F.col("raw")))
    get = lambda p, t: F.try_variant_get("value", p, t)
    items = judged.filter("error is null").select(
        F.coalesce(trimmed(get("$.source", "string")), F.lit(source)).alias("source"), F.lit(split).alias("source_split"), F.col("ordinal").alias("source_index"),
        F.when(kind(get("$.content", "variant")) == "STRING", get("$.content", "string")).otherwise(F.to_json(get("$.content", "variant"))).alias("content"),
        kind(get("$.content", "variant")).alias("content_kind"), get("$.label", "int").alias("label"), collapsed(get("$.reason", "string")).alias("reason"), "file", "line",
    )
    return items, judged.filter("error is not null").select("file", "line", "raw", "error")


def strict(rows: DataFrame, error: str = "error") -> DataFrame:
    """Fails the job at the first row with an error; the check is in a column that stays, so that it can't be pruned."""
    where = F.concat_ws(":", "file", F.col("line").cast("string"))
    return rows.withColumn("line", F.when(F.col(error).isNull(), F.col("line")).otherwise(F.raise_error(F.concat_ws(" ", where, F.col(error))).cast("int"))).drop(error)


def shards(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Prediction shards with the name of their file and the line's place in it; a line that doesn't parse is in _corrupt_record."""
    lines = spark.read.schema(schema + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(glob)
    return lines.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def resumed(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """The rows of the shards that an earlier run has written.

    A process that was killed leaves its shard's last line half written: ValueError names the shard, so that the line can be trimmed.
    A line before the last that doesn't parse is an error as well, with another text. Rows have the shard's name in `file`.
    """
    rows = materialize(shards(spark, glob, schema), "shards")
    last = rows.groupBy("file").agg(F.max(F.struct("block", "at", "_corrupt_record")).alias("x"), F.count("_corrupt_record").alias("n")).filter("n > 0").orderBy("file").first()
    if last:
        where = "its last line, which has to be trimmed" if last.n == 1 and last.x["_corrupt_record"] is not None else "a line before its last"
        raise ValueError(f"{last.file}: {last.n} invalid, {where}")
    return rows.drop("_corrupt_record", "block", "at")


_STEP = r"^(\d+)\.jsonl$"


def step_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Validation dumps named <step>.jsonl, with their step.

    In a folder, files with other names are left out; a single file with another name, a folder without any dump, and an empty
    file are a ValueError. Rows come with their step; sort by it where an order is shown.
    """
    fs, at = file_system(spark, path)
    status = fs.getFileStatus(at)
    found = [f for f in (fs.listStatus(at) if status.isDirectory() else [status]) if re.match(_STEP, f.getPath().getName())]
    if not found:
        raise ValueError(f"{path}: no file named by its step")
    empty = sorted(f.getPath().getName() for f in found if not f.getLen())
    if empty:
        raise ValueError(f"{path}: empty: {', '.join(empty)}")
    rows = spark.read.schema(schema).json([f.getPath().toString() for f in found])
    return rows.withColumn("step", F.regexp_extract("_metadata.file_name", _STEP, 1).cast("int"))


def checkpoints(spark: SparkSession, folder: str, prefix: str = "checkpoint-") -> DataFrame:
    """(step, path) of the folders named by a prefix and a number, in numeric order; a missing folder has none. The driver lists them: they are few."""
    fs, at = file_system(spark, folder)
    names = [(f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []
    found = sorted((int(n[len(prefix) :]), p) for n, p in names if n.startswith(prefix) and n[len(prefix) :].isascii() and n[len(prefix) :].isdigit())
    return spark.createDataFrame(found, "step long, path string")


def files(spark: SparkSession, glob: str) -> DataFrame:
    """(file, size, modified, sha256) of files; each is read by one task."""
    return spark.read.format("binaryFile").load(glob).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def config(path: str, lenient: bool = False) -> dict:
    """A JSON or (by its suffix) YAML object read on the driver; a missing or broken file is an error, or {} if lenient."""
    try:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                found = yaml.safe_load(f)
            else:
                found = json.load(f)
    except (OSError, ValueError):
        if lenient:
            return {}
        raise
    if not isinstance(found, dict):
        if lenient:
            return {}
        raise ValueError(f"{path} isn't an object")
    return found


def located(path: str) -> tuple:
    """(file system, path in it) of a path or a URI, for code that runs in Python workers."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def register(spark: SparkSession) -> None:
    """Makes the reader available as spark.read.format("labelled_jsonl").load(path): a file, a pattern or a folder.

    One file is one task; jsonl() reads large files in ranges.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, paths: list[str]) -> None:
            self.paths = paths

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(p) for p in self.paths]

        def read(self, partition: InputPartition):
            import io
            import json

            from veritrace.sources.records import located

            ordinal = 0
            fs, path = located(partition.value)
            with fs.open_input_stream(path) as f:
                for k, line in enumerate(io.TextIOWrapper(f, encoding="utf-8", newline="\n"), 1):
                    if line.strip():
                        try:
                            json.loads(line)
                            ok = True
                        except ValueError:
                            ok = False
                        yield (partition.value, k, ordinal, line.rstrip("\r\n"), ok)
                        ordinal += 1

    class LabelledJsonl(DataSource):
        @classmethod
        def name(cls) -> str:
            return "labelled_jsonl"

        def schema(self) -> str:
            return "file string, line int, ordinal int, raw string, is_json boolean"

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            from pyarrow.fs import FileSelector, FileType

            fs, path = located(self.options["path"])
            folder, _, pattern = path.rpartition("/")
            if fs.get_file_info(path).type == FileType.Directory:
                folder, pattern = path, "*.jsonl"
            prefix = self.options["path"].removesuffix(path)
            names = [i.path for i in fs.get_file_info(FileSelector(folder or ".")) if i.type == FileType.File and fnmatch(i.base_name, pattern)]
            return Reader([prefix + n for n in sorted(names)])

    spark.dataSource.register(LabelledJsonl)
