"""Vectors for texts, by a function that callers give (a model's client): called in tasks, a few texts at a time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts whose vectors are made at the same time by a task.
AT_ONCE = 4


def embedded(df: DataFrame, embed: Callable[[str], list[float]], text: str = "text", to: str = "embedding", at_once: int = AT_ONCE, seconds: float = 60.0) -> DataFrame:
    """df with a column of vectors. A text that is null, whose call fails, tells no numbers or takes longer than `seconds` gets null; nothing else is lost for it.

    Each text is one call, `at_once` of them at the same time in a task, whatever the size of a batch. A call that is
    over time is waited for no longer; its thread ends when it does.
    """
    schema = T.StructType([*(f for f in df.schema.fields if f.name != to), T.StructField(to, T.ArrayType(T.DoubleType()))])
    place = [f.name for f in df.schema.fields if f.name != to]

    def run(batches):
        for batch in batches:
            pool = ThreadPoolExecutor(at_once)
            made: list[list[float] | None] = []
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a in range(0, len(texts), at_once):
                # a few calls are open at once, so that the time of each is its own and not that of a queue
                calls = [None if t is None else pool.submit(embed, t) for t in texts[a : a + at_once]]
                slow = False
                for call in calls:
                    try:
                        made.append(None if call is None else [float(x) for x in call.result(seconds)])
                    except Exception as e:  # noqa: BLE001  (a row without a vector is a result)
                        made.append(None)
                        slow = slow or isinstance(e, TimeoutError)
                if slow:
                    pool.shutdown(wait=False)
                    pool = ThreadPoolExecutor(at_once)
            pool.shutdown(wait=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in place), pa.array(made, pa.list_(pa.float64()))], [*place, to])

    return df.select(*place).mapInArrow(run, schema)
