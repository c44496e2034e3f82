"""Batch inference with a model function the caller supplies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Messages = list[dict]
Generate = Callable[[list[Messages]], list[str]]
Call = Callable[[Messages], dict]


def complete(
    df: DataFrame,
    make_generate: Callable[[], Generate],
    batch_size: int = 8,
    messages: str = "messages",
    output: str = "raw",
) -> DataFrame:
    """Add the completion of every row's messages; rows keep all their columns.

    ``make_generate`` runs once per task and returns a function from a list of
    message lists to as many completions. It never sees more than ``batch_size``
    conversations at a time. Repartition first where few input splits would leave
    model workers idle.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = make_generate()
        for batch in batches:
            conversations = batch.column(messages).to_pylist()
            answers: list[str] = []
            for start in range(0, len(conversations), batch_size):
                part = conversations[start : start + batch_size]
                given = generate(part)
                if len(given) != len(part):
                    raise ValueError(f"{len(part)} conversations gave {len(given)} completions")
                answers.extend(given)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(answers, pa.string())],
                names=[*batch.schema.names, output],
            )

    return df.mapInArrow(run, schema)


CALL_FIELDS = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("latency", T.DoubleType()),
        T.StructField("out_tokens", T.LongType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("start_ts", T.TimestampType()),
        T.StructField("end_ts", T.TimestampType()),
    ]
)
_CALL_ARROW = pa.struct(
    [
        ("ok", pa.bool_()),
        ("latency", pa.float64()),
        ("out_tokens", pa.int64()),
        ("prompt_tokens", pa.int64()),
        ("error", pa.string()),
        ("start_ts", pa.timestamp("us", "UTC")),
        ("end_ts", pa.timestamp("us", "UTC")),
    ]
)


@dataclass
class _Record:
    """One call, in the order of the record's fields (fixed values: their names)."""

    ok: bool = False
    latency: float = 0.0
    out_tokens: int | None = None
    prompt_tokens: int | None = None
    error: str | None = None
    start_ts: datetime | None = None
    end_ts: datetime | None = None


@contextmanager
def _timed() -> Iterator[_Record]:
    """A record that knows when it began and ended, and what went wrong in between."""
    record = _Record(start_ts=datetime.now(timezone.utc))
    tick = time.perf_counter()
    try:
        yield record
        record.ok = True
    except Exception as error:  # noqa: BLE001 - any failure is a data point
        record.error = str(error)
    record.latency = time.perf_counter() - tick
    record.end_ts = datetime.now(timezone.utc)


def _record(call: Call, conversation: Messages) -> dict:
    with _timed() as record:
        usage = call(conversation)
        counts = [usage.get(f"{name}_tokens", 0) for name in ("completion", "prompt")]
        record.out_tokens, record.prompt_tokens = counts
    return asdict(record)


def timed_calls(
    df: DataFrame, make_call: Callable[[], Call], keep: list[str], messages: str = "messages"
) -> DataFrame:
    """Call a model once per row and record success, time, token counts or the error.

    ``make_call`` runs once per task and returns a function from messages to a dict
    with ``completion_tokens`` and ``prompt_tokens`` (absent counts are 0). A call
    that raises becomes a row with ``ok`` false; the job goes on. The columns of
    ``keep`` stay.
    """
    schema = T.StructType([*df.select(*keep).schema.fields, *CALL_FIELDS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make_call()
        for batch in batches:
            records = pa.array(
                [_record(call, cell) for cell in batch.column(messages).to_pylist()],
                _CALL_ARROW,
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in keep], *records.flatten()],
                names=schema.fieldNames(),
            )

    return df.select(*dict.fromkeys([*keep, messages])).mapInArrow(run, schema)


def attach_completions(
    examples: DataFrame, completions: DataFrame, id_column: str = "id"
) -> DataFrame:
    """Examples with completions that were made elsewhere, matched by id, never by position."""
    return examples.join(completions, id_column)
