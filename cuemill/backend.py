"""External work (model inference, search, upload) behind an interface; recorded results can be replayed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Backend(Protocol):
    def run(self, requests: DataFrame) -> DataFrame:
        """``request_id, response`` for requests with ``request_id, prompt``."""


class ReplayBackend:
    """Answers from recorded ``request_id, response`` rows; a request without a record gets a null response."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def run(self, requests: DataFrame) -> DataFrame:
        return requests.select("request_id").join(self.recorded.select("request_id", "response"), "request_id", "left")


class BatchBackend:
    """Calls a function on Arrow batches inside the executors; ``slots`` bounds how many run at once."""

    def __init__(self, call: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], slots: int):
        self.call, self.slots = call, slots

    def run(self, requests: DataFrame) -> DataFrame:
        return requests.select("request_id", "prompt").repartition(self.slots).mapInArrow(self.call, "request_id string, response string")
