"""Writers: JSONL that keeps nulls, aligned dataset and manifest, small documents, folders that flip together, digests and reports.

Everything goes through Hadoop's file systems, so that small documents land beside the tables they describe.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veritrace.runtime import file_system


def json_lines(df: DataFrame) -> DataFrame:
    """One column value: each row as a compact JSON object, nulls kept."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c != "_line"]), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: str | None = None, mode: str = "errorifexists") -> int:
    """One compact JSON object a line, nulls kept; sorted by range if an order is given, so files in name order are in order.

    Returns the number of rows, which is observed as they are written.
    """
    seen = Observation()
    rows = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    # after the shuffle, because ranges are found by running what is before it once more
    json_lines(rows.observe(seen, F.count(F.lit(1)).alias("n"))).write.mode(mode).text(path)
    return seen.get["n"]


def write_aligned(items: DataFrame, dataset: list[str], manifest: list[str], folder: str, line: str = "sft_line") -> int:
    """Dataset and manifest from one ordering; both keep the line number, so they stay aligned whatever the files are."""
    n = write_jsonl(items.select(line, *dataset), f"{folder}/dataset", line)
    if write_jsonl(items.select(line, *manifest), f"{folder}/manifest", line) != n:
        raise RuntimeError("dataset and manifest differ in length")
    return n


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) that don't depend on the order of rows: sums of two 64-bit hashes, aggregated where the rows are."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count("*"), h(1), h(2)).first()
    return n, f"{int(a or 0) % 2**64:016x}{int(b or 0) % 2**64:016x}"


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small document: created under a name of its own in the same folder, then renamed over what is there.

    A reader sees the old document or the new one. Keys are sorted. A failure leaves the old one, and no other file.
    """
    fs, at = file_system(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft = hadoop.Path(at.getParent(), f"_{at.getName()}-{uuid.uuid4().hex}")
    done = False
    try:
        with _closing(fs.create(draft, False)) as out:
            out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1), "utf-8"))
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        flags = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        flags[0] = hadoop.Options.Rename.OVERWRITE
        context.rename(draft, at, flags)
        done = True
    finally:
        if not done:
            fs.delete(draft, False)


class _closing:
    """A stream of the other runtime, closed at the end."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def __enter__(self):
        return self.stream

    def __exit__(self, *_) -> None:
        self.stream.close()


def read_json(spark: SparkSession, path: str) -> object:
    """The document at path; FileNotFoundError without one, ValueError if it isn't JSON."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    with _closing(fs.open(at)) as stream:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))


def publish(spark: SparkSession, target: str, write: Callable[[str], None], overwrite: bool = False) -> None:
    """Runs write(folder) on a staging folder beside target and renames it to target once everything in it is there.

    FileExistsError if target exists and isn't to be replaced, or if a staging folder was left by another run, which is never
    touched. If write fails, its staging folder is removed and target stays as it was.
    """
    fs, at = file_system(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    staging, old = (path(at.getParent(), f".{at.getName()}.{x}") for x in ("staging", "replaced"))
    if fs.exists(at) and not overwrite:
        raise FileExistsError(target)
    if fs.exists(staging):
        raise FileExistsError(f"{staging.toString()} was left by another run")
    fs.mkdirs(staging)
    try:
        write(staging.toString())
        if fs.exists(at) and not fs.rename(at, old):
            raise OSError(f"can't replace {target}")
        if not fs.rename(staging, at):
            fs.rename(old, at)
            raise OSError(f"can't put {target} in its place")
    finally:
        fs.delete(staging, True)
        if fs.exists(at):
            fs.delete(old, True)


def swap(spark: SparkSession, staging: str, target: str, overwrite: bool = False) -> None:
    """Puts a folder that was written completely in its place, by publish()."""
    fs, at = file_system(spark, staging)

    def move(folder: str) -> None:
        inside = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for entry in fs.listStatus(at):
            fs.rename(entry.getPath(), spark._jvm.org.apache.hadoop.fs.Path(inside, entry.getPath().getName()))
        fs.delete(at, True)

    publish(spark, target, move, overwrite)


def point(spark: SparkSession, folder: str, name: str, step: int, checkpoint: str) -> None:
    """A pointer (best, latest) as a document in folder; links aren't something that object stores have."""
    write_json(spark, f"{folder}/{name}.json", {"step": step, "checkpoint": checkpoint})


# The description of chat datasets that a public trainer reads.
REGISTRY_FORMAT = "sharegpt"
REGISTRY_COLUMNS = {"messages": "messages"}
REGISTRY_TAGS = {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant", "system_tag": "system"}


def registry(names: dict[str, str]) -> dict:
    """Description of chat datasets by name and file, for trainers that read one."""
    return {n: {"file_name": f, "formatting": REGISTRY_FORMAT, "columns": REGISTRY_COLUMNS, "tags": REGISTRY_TAGS} for n, f in names.items()}


def metrics_document(metrics: DataFrame, model: str, source: str = "source") -> dict:
    """The metrics of an evaluation as one document: model, overall, by source, and how unparsed answers were counted."""
    rows = [r.asDict() for r in metrics.collect()]
    plain = lambda r: {k: v for k, v in r.items() if k not in (source, "is_overall")}
    overall = [plain(r) for r in rows if r["is_overall"]]
    return {"model": model, "overall": overall[0] if overall else None, "by_source": {r[source]: plain(r) for r in rows if not r["is_overall"]}, "unparsed": "count_as_incorrect"}


def step_table(metrics: DataFrame, columns: list[str], step: str = "step") -> str:
    """The overall row of every step, in the order of steps."""
    rows = [r.asDict() for r in metrics.filter("is_overall").orderBy(step).collect()]
    return markdown(rows, [step, *columns])


def markdown(rows: list[dict], columns: list[str], digits: int = 4) -> str:
    """A table of collected rows; numbers with `digits` decimals, null as -."""
    show = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def metric_table(metrics: DataFrame, source: str = "source", order: list[str] | None = None) -> str:
    """Sources in the given order (else by name), then Overall. One row a source reaches the driver."""
    rows = [r.asDict() for r in metrics.collect()]
    place = {s: i for i, s in enumerate(order or [])}
    rows.sort(key=lambda r: (r["is_overall"], place.get(r[source], len(place)), r[source] or ""))
    for r in rows:
        if r["is_overall"]:
            r[source] = "Overall"
    return markdown(rows, [source, *[c for c in metrics.columns if c not in (source, "is_overall")]])
