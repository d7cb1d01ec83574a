"""Requests to models, batch inference and run records."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from devident.fixed_values import STATUS_COMPLETE, STATUS_ERROR
from devident.functions.documents import to_json_text
from devident.operators.outputs import extract_object, filter_predictions
from devident.session import materialize


@dataclass(frozen=True)
class ModelSettings:
    """One model configuration of a sweep."""

    name: str
    version: str = ""
    temperature: float = 0.0
    top_p: float = 1.0
    max_tokens: int = 2048
    seed: int | None = 42


class Backend(Protocol):
    """What the caller plugs in. Built once per task and model; `chat` answers one request.

    A backend that cannot seed says so by `supports_seed = False`; its runs carry no seed.
    """

    supports_seed: bool = True

    def chat(
        self, messages: list[dict], *, temperature: float, top_p: float, seed: int | None, max_tokens: int
    ) -> str: ...


_SETTINGS = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("top_p", T.DoubleType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("seed", T.LongType()),
    ]
)


def with_settings(df: DataFrame, settings: ModelSettings) -> DataFrame:
    """Stamp one configuration on every row."""
    values = (
        settings.name, settings.version, settings.temperature, settings.top_p, settings.max_tokens, settings.seed,
    )
    return df.withColumns(
        {f.name: F.lit(v).cast(f.dataType) for f, v in zip(_SETTINGS.fields, values)}
    )


def sweep(inputs: DataFrame, prompt_ids: Sequence[int], settings: Iterable[ModelSettings]) -> DataFrame:
    """Design grid `aggregated_input_id, prompt_id, <settings>`: every input with every cell.

    The cells are the caller's list (prompts × configurations), so they are exploded from a literal
    inside each row: no join and no shuffle.
    """
    cells = [
        F.struct(
            F.lit(prompt).cast("long").alias("prompt_id"),
            *[
                F.lit(value).cast(f.dataType).alias(f.name)
                for f, value in zip(
                    _SETTINGS.fields, (s.name, s.version, s.temperature, s.top_p, s.max_tokens, s.seed)
                )
            ],
        )
        for prompt in prompt_ids
        for s in settings
    ]
    grid = inputs.select(F.col("id").alias("aggregated_input_id"), F.explode(F.array(*cells)).alias("_cell"))
    return grid.select("aggregated_input_id", "_cell.*")


def build_requests(asked: DataFrame, inputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Add `messages` (system prompt, then payload) to rows with `aggregated_input_id` and `prompt_id`.

    Unknown inputs or prompts give no row; see `rejected_requests`.
    """
    payloads = inputs.select(F.col("id").alias("aggregated_input_id"), F.col("input_payload_json").alias("_payload"))
    texts = prompts.select(F.col("id").alias("prompt_id"), F.col("prompt_text").alias("_prompt"))

    def message(role: str, column: str):
        return F.struct(F.lit(role).alias("role"), F.col(column).alias("content"))

    joined = asked.join(payloads, "aggregated_input_id").join(texts, "prompt_id")
    return joined.select(
        *asked.columns, F.array(message("system", "_prompt"), message("user", "_payload")).alias("messages")
    )


def rejected_requests(asked: DataFrame, inputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Requests that name an unknown input, or else an unknown prompt, with the `reason`."""
    no_input = asked.join(inputs.select(F.col("id").alias("aggregated_input_id")), "aggregated_input_id", "left_anti")
    known = asked.join(inputs.select(F.col("id").alias("aggregated_input_id")), "aggregated_input_id", "left_semi")
    no_prompt = known.join(prompts.select(F.col("id").alias("prompt_id")), "prompt_id", "left_anti")
    columns = asked.columns
    return (
        no_input.select(*columns, F.lit("unknown input").alias("reason"))
        .unionByName(no_prompt.select(*columns, F.lit("unknown prompt").alias("reason")))
    )


def infer(
    requests: DataFrame, backend: Callable[[str, str], Backend], tasks: int | None = None
) -> DataFrame:
    """Run every request through the caller's backend of its model.

    Adds `raw_output_text` (stripped), `status`, `error_text` and the start and end stamps. A request that
    fails is marked and does not stop the others. `backend(model_name, model_version)` is called once per task and
    model. Requests are small but slow: they are dealt over `tasks` tasks, by default as many as the session's shuffles
    have, and never coalesced by their bytes.
    """
    number = tasks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = requests.repartition(number, F.xxhash64("aggregated_input_id", "prompt_id", "model_name", "model_version"))
    added = ["raw_output_text", "status", "error_text", "started_at", "ended_at"]
    # a backend that cannot seed turns a seed into NULL
    fields = [T.StructField(f.name, f.dataType, f.nullable or f.name == "seed") for f in asked.schema.fields]
    schema = T.StructType(fields + [T.StructField(n, T.StringType()) for n in added])
    seed_at = asked.columns.index("seed")

    def stamp() -> str:
        return datetime.now(timezone.utc).isoformat()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict = {}

        def model_of(name: str, version: str):
            if (name, version) not in models:
                try:
                    models[name, version] = backend(name, version), None
                except Exception as problem:  # a backend that cannot start fails its requests, not the job
                    models[name, version] = None, problem
            return models[name, version]

        for batch in batches:
            results, seeds = [], []
            for row in batch.to_pylist():
                started = stamp()
                model, failed = model_of(row["model_name"], row["model_version"])
                if not getattr(model, "supports_seed", True):
                    row["seed"] = None
                seeds.append(row["seed"])
                try:
                    if failed is not None:
                        raise failed
                    text = model.chat(
                        row["messages"],
                        temperature=row["temperature"],
                        top_p=row["top_p"],
                        seed=row["seed"],
                        max_tokens=row["max_tokens"],
                    ).strip()
                    results.append((text, STATUS_COMPLETE, None, started, stamp()))
                except Exception as problem:
                    results.append(("", STATUS_ERROR, str(problem), started, stamp()))
            outcome = [pa.array([r[i] for r in results], pa.string()) for i in range(len(added))]
            columns = list(batch.columns)
            columns[seed_at] = pa.array(seeds, columns[seed_at].type)
            yield pa.RecordBatch.from_arrays([*columns, *outcome], [*batch.schema.names, *added])

    return asked.mapInArrow(answer, schema)


def infer_in_rounds(
    requests: DataFrame, backend: Callable[[str, str], Backend], folder: str, rounds: int, tasks: int | None = None
) -> DataFrame:
    """As `infer`, in `rounds` jobs that keep their answers below `folder`, which driver and executors share.

    A round asks for one share of the requests, by a hash, less those that have an answer below the folder. A job that dies
    loses the calls of its own round; called again with the same folder, only requests without an answer are asked, so the
    share of calls that can be lost at once is 1 / `rounds`. Equal requests are trials of their own, told apart by a number. A task
    has one call in flight. Answers below the folder to requests that aren't asked now stay there and aren't returned.
    """
    spark = requests.sparkSession
    names = requests.columns
    said = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    folded = requests.withColumn("_request", F.sha2(said, 256)).groupBy("_request").agg(
        F.any_value(F.struct(*names)).alias("_asked"), F.count("*").alias("_copies")
    )
    trials = materialize(folded.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_request", "_copy", "_asked.*"))
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def answered() -> list[str]:
        found = files.listStatus(place) if files.exists(place) else []
        done = [f.getPath() for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return sorted(p.toString() for p in done)

    schema = None
    for number in range(rounds):
        share = trials.filter(F.pmod(F.xxhash64("_request", "_copy"), F.lit(rounds)) == number)
        if before := answered():
            share = share.join(spark.read.parquet(*before).select("_request", "_copy"), ["_request", "_copy"], "left_anti")
        answers = infer(share, backend, tasks)
        schema = answers.schema
        if share.limit(1).count():
            answers.write.parquet(f"{folder.rstrip('/')}/round-{uuid.uuid4().hex}")
    if not (done := answered()):
        return spark.createDataFrame([], schema).drop("_request", "_copy")
    return spark.read.schema(schema).parquet(*done).join(trials.select("_request", "_copy"), ["_request", "_copy"], "left_semi").drop("_request", "_copy")


def run_records(answered: DataFrame) -> DataFrame:
    """Run rows without key: identifiers extracted and filtered, full settings stamped.

    A list that cannot be read turns a run into a failed one that keeps its raw output.
    """
    read = filter_predictions(extract_object(answered, "raw_output_text"))
    complete = F.col("status") == STATUS_COMPLETE
    unreadable = complete & F.col("filter_error").isNotNull()
    return read.select(
        "aggregated_input_id",
        F.lit(None).cast("long").alias("experiment_id"),
        "prompt_id",
        F.lit(1).alias("trial_number"),
        "model_name",
        "model_version",
        "temperature",
        "top_p",
        "max_tokens",
        "seed",
        to_json_text(F.col("messages")).alias("conversation_history_json"),
        "raw_output_text",
        F.when(complete, F.col("parsed_output_json")).alias("parsed_output_json"),
        "started_at",
        "ended_at",
        F.when(unreadable, STATUS_ERROR).otherwise(F.col("status")).alias("status"),
        F.when(unreadable, F.col("filter_error")).otherwise(F.col("error_text")).alias("error_text"),
    )
