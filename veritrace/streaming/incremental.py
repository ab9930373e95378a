"""Incremental forms: resumable scoring, running metrics, and best and latest checkpoints as validations arrive."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.operators.metrics import counts, rates
from veritrace.runtime import file_system, shared_dir


def table_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A parquet file or folder as a stream of its files."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def drained(stream: DataFrame, mode: str, name: str, folder: str | None = None) -> DataFrame:
    """Runs a stream until its source is read up and returns what has come out, from `folder`.

    folder holds the checkpoint and the output: a later call with the same folder, in this process or another, goes on where the
    last one ended, or was killed, and returns the output of all of them; a batch that is run again replaces itself, so
    each row is counted once. Without a folder the run begins anew in one of its own. complete mode keeps the last batch, append
    mode all of them.
    """
    spark = stream.sparkSession
    base = folder or f"{shared_dir(spark)}/veritrace/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, epoch: int) -> None:
        where = f"{base}/out/last" if mode == "complete" else f"{base}/out/epoch={epoch}"
        batch.write.mode("overwrite").parquet(where)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    fs, at = file_system(spark, f"{base}/out")
    if not fs.exists(at):  # nothing ever came
        return spark.createDataFrame([], stream.schema)
    where = f"{base}/out/last" if mode == "complete" else f"{base}/out/epoch=*"
    return spark.read.schema(stream.schema).parquet(where)


def running_metrics(predictions: DataFrame, source: str = "source") -> DataFrame:
    """Counters per source of a stream (gold, pred, source); they add up over batches."""
    return predictions.groupBy(source).agg(*counts())


def stream_metrics(predictions: DataFrame, source: str = "source", folder: str | None = None) -> DataFrame:
    """Metrics of a stream once it is drained: the same as of the whole table. With a folder, later calls add what has come since."""
    return rates(drained(running_metrics(predictions, source), "complete", "metrics", folder))


def once_each(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key of a stream; state has one entry a key, so keys should be bounded by a watermark or by the task."""
    return stream.dropDuplicates(keys)


def windowed_counts(stream: DataFrame, time: str, late: str, size: str, by: list[str]) -> DataFrame:
    """Rows by time window and key; what comes later than `late` behind the newest row is left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"))


def due(step: str = "step", every: int = 50):
    """Steps at which a run is validated: the first, then every so many."""
    return (F.col(step) == 1) | (F.col(step) % every == 0)


_STATE = "run string, best_step long, k1 double, k2 double, k3 double, latest_step long, behind long, pending string"
_OUT = "run string, step long, best_step long, latest_step long, kept string"


def retention(events: DataFrame, most_waiting: int = 1000) -> DataFrame:
    """Best and latest checkpoint of each run, from a stream of (run, step, kind, k1, k2, k3).

    kind is 'validation' (with its key) or 'save'; a step counts when both have come, in either order. One row is put out for each
    step committed. Equal keys keep the earlier step. State is the best, the latest, the last `most_waiting` steps (those of which an
    event is missing and those that are done, so that a repeated event changes nothing), and the step they begin after: an event
    of a step that far behind is left out. So it has a bound whatever the number of steps.
    """

    def step(key, frames, state):
        (run,) = key
        import json

        best, k, latest, behind, seen = None, None, None, -1, {}
        if state.exists:
            _, best, k1, k2, k3, latest, behind, kept = state.get
            seen = {int(s): w for s, w in json.loads(kept).items()}
            best, latest = (None if x is None or x < 0 else int(x) for x in (best, latest))
            k = None if best is None else (k1, k2, k3)
        out = []
        for frame in frames:
            for e in frame.sort_values(["step", "kind"]).itertuples():
                s = int(e.step)
                if s <= behind or seen.get(s) == "done":
                    continue
                w = seen.setdefault(s, {})
                w[e.kind] = [e.k1, e.k2, e.k3] if e.kind == "validation" else True
                if len(w) < 2:
                    continue
                new = tuple(w["validation"])
                seen[s] = "done"
                if k is None or new > k or (new == k and s < best):
                    best, k = s, new
                latest = max(latest or 0, s)
                out.append((run, s, best, latest, ",".join(map(str, sorted({best, latest})))))
        for s in sorted(seen)[: max(0, len(seen) - most_waiting)]:
            behind = max(behind, s)
            del seen[s]
        state.update((run, -1 if best is None else best, *(k or (0.0, 0.0, 0.0)), -1 if latest is None else latest, behind, json.dumps(seen)))
        yield pd.DataFrame(out, columns=["run", "step", "best_step", "latest_step", "kept"])

    return events.groupBy("run").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")
