"""Run a caller's completion function over a table of prompts."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# workers get the functions themselves and need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Complete = Callable[[str, int | None], tuple[str, int]]


def _call(fn: Complete, prompt: str, max_tokens: int | None) -> tuple[str, int, int, bool]:
    start = time.monotonic()
    try:
        response, tokens = fn(prompt, max_tokens)
        return response, int(tokens), int((time.monotonic() - start) * 1000), True
    except Exception as error:  # one failed call is one failed row
        return f"Error: {error}", 0, 0, False


def batch_complete(prompts: DataFrame, fn: Complete, key: str = "id", prompt: str = "prompt",
                   max_tokens: str | None = None, concurrency: int = 2, partitions: int | None = None,
                   keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Call ``fn(prompt, max_tokens) -> (response, tokens)`` for every row.

    Calls at once = running tasks x ``concurrency``; ``partitions`` sets how many tasks there are.  A call
    that raises becomes an ``Error: ...`` row with no tokens and ``ok`` false.  Columns named in ``keep`` pass unchanged.
    """
    schema = T.StructType([
        T.StructField(key, prompts.schema[key].dataType), T.StructField("response", T.StringType()),
        T.StructField("tokens_used", T.LongType()), T.StructField("duration_ms", T.LongType()),
        T.StructField("ok", T.BooleanType()), *[T.StructField(c, prompts.schema[c].dataType) for c in keep]])
    limit = F.col(max_tokens).cast("bigint") if max_tokens else F.lit(None).cast("bigint")
    slim = prompts.select(key, F.col(prompt).alias("_prompt"), limit.alias("_max_tokens"), *keep)
    if partitions:
        slim = slim.repartition(partitions, key)
    names, kinds = schema.names, (pa.string(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for batch in batches:
                asked, limits = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                rows = [None] * len(asked)
                numbers = iter(range(len(asked)))

                def work():     # each thread takes the next open row
                    for i in numbers:
                        rows[i] = _call(fn, asked[i], limits[i])

                for done in [pool.submit(work) for _ in range(concurrency)]:
                    done.result()
                made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:]], names=names)

    return slim.mapInArrow(run, schema)
