"""Asking a model in rounds: each round asks only what has no usable answer yet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scoreflow.functions.rows import grows
from scoreflow.operators.narrative import MAX_ATTEMPTS, parse_responses
from scoreflow.sources.tables import TableStore


def ask_in_rounds(
    store: TableStore,
    name: str,
    prompts: DataFrame,
    model: Callable[[DataFrame], DataFrame],
    keys: list[str],
    fields: list[str],
    max_attempts: int = MAX_ATTEMPTS,
) -> tuple[DataFrame, list[int]]:
    """(All responses with the attempt they belong to, number of prompts asked in each round).

    ``model`` turns prompts with their ``attempt`` into rows with the keys and a ``response``. A round's
    prompts and responses are stored under ``name`` before they are judged, so a lost executor asks
    nothing again; the number of prompts comes with their write. The rounds end when every prompt has a
    usable response, or after ``max_attempts``. A prompt with a null key, which no response can match, is asked
    in every round.
    """
    if max_attempts < 1:
        raise ValueError("max_attempts must be at least 1")
    todo, told, counts = prompts, [], []
    for attempt in range(1, max_attempts + 1):
        seen = Observation()
        counted = todo.withColumn("attempt", F.lit(attempt)).observe(seen, F.count(F.lit(1)).alias("rows"))
        asked = store.scratch(f"{name}-asked-{attempt}", counted)
        if attempt > 1 and not seen.get["rows"]:
            break
        counts.append(seen.get["rows"])
        responses = model(asked).select(*keys, F.lit(attempt).alias("attempt"), "response")
        told.append(store.scratch(f"{name}-told-{attempt}", responses))
        usable = parse_responses(told[-1], keys, fields).select(*keys)
        todo = asked.drop("attempt").join(grows(usable), keys, "left_anti")
    return reduce(DataFrame.unionByName, told), counts
