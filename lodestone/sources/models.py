"""Models behind small interfaces, called from partitions with retries; deterministic stand-ins for offline use."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ensure_importable

ATTEMPTS = 3


def ask(rows: DataFrame, model: Callable[[str], str], prompt: str = "prompt", out: str = "answer", pause: float = 0.0) -> DataFrame:
    """Adds a model's answer to each prompt: at most three attempts, waiting longer after each; null if all fail."""
    ensure_importable(rows.sparkSession)
    schema = f"{rows.schema.toDDL()}, {out} STRING"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for text in batch[prompt]:
                answer = None
                for k in range(1, ATTEMPTS + 1):
                    try:
                        answer = model(text)
                        break
                    except Exception:  # noqa: BLE001  what a client may raise is its own
                        time.sleep(pause * k)
                answers.append(answer)
            yield batch.assign(**{out: pd.Series(answers, index=batch.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def ask_json(rows: DataFrame, model: Callable[[str], str], schema: str, prompt: str = "prompt", out: str = "record", pause: float = 0.0) -> DataFrame:
    """Adds a model's answer as a record: an answer that is no JSON object or list, fence or not, counts as a failed
    attempt, of which there are three."""

    def checked(text: str) -> str:
        answer = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", model(text))
        if not isinstance(json.loads(answer), dict | list):
            raise ValueError("no record")
        return answer

    return ask(rows, checked, prompt, "_answer", pause).withColumn(out, F.from_json("_answer", schema)).drop("_answer")


def echo(prompt: str) -> str:
    """The stand-in for a model that writes answers: the evidence as it was put together."""
    return prompt
