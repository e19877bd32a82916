"""A paced client for a provider, and the fetch of many requests on Spark. The transport is given, so all of it runs without a network too."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: (path, parameters) -> (status, body); status 0 if there was no answer.
Transport = Callable[[str, dict[str, str]], tuple[int, str]]
MOST_TRIES, QUOTE_BATCH = 6, 200
LEAST_MS, MOST_MS = 12, 400


class ProviderError(RuntimeError):
    def __init__(self, status: int, path: str) -> None:
        super().__init__(f"status {status} from {path}")
        self.status = status


def api_key(names: Sequence[str], environment: dict[str, str] | None = None) -> str | None:
    """The first of these settings that is not blank."""
    env = os.environ if environment is None else environment
    return next((v for n in names if (v := env.get(n, "").strip())), None)


class Provider:
    """Requests at a shared pace: wider after a refusal, slowly narrower after a success."""

    def __init__(self, transport: Transport, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, spread: int = 1) -> None:
        self.transport, self.sleep, self.clock = transport, sleep, clock
        # One of ``spread`` clients takes its share of the pace.
        self.least, self.most = float(LEAST_MS * spread), float(MOST_MS * spread)
        self.interval, self.open_at, self.requests, self.refusals = self.least, 0.0, 0, 0

    def _wait(self) -> None:
        now = self.clock()
        at = max(now, self.open_at)
        self.open_at = at + self.interval / 1000
        self.requests += 1
        if at > now:
            self.sleep(at - now)

    def _refused(self, attempt: int) -> None:
        self.refusals += 1
        self.interval = min(self.most, self.interval * 2)
        self.open_at = max(self.open_at, self.clock() + 2.0 * attempt)

    def get(self, path: str, params: dict[str, str] | None = None) -> Any:
        return json.loads(self.text(path, params))

    def text(self, path: str, params: dict[str, str] | None = None) -> str:
        """The answer. 429 closes the gate for all, 402 is final, anything else backs off."""
        for attempt in range(1, MOST_TRIES + 1):
            self._wait()
            status, body = self.transport(path, params or {})
            if status == 200:
                self.interval = max(self.least, self.interval * 0.98)
                return body
            if status == 402 or attempt == MOST_TRIES:
                raise ProviderError(status, path)
            if status == 429:
                self._refused(attempt)
            else:
                self.sleep(0.8 * attempt)
        raise AssertionError

    def reachable(self, path: str, params: dict[str, str] | None = None) -> bool:
        try:
            self.get(path, params)
        except (ProviderError, ValueError, OSError):
            return False
        return True


def http(base: str, key: str | None = None, timeout: float = 30.0) -> Transport:
    """A transport over HTTP: GET of base/path with the parameters, and ``apikey`` if there is a key."""
    root = base.rstrip("/")

    def call(path: str, params: dict[str, str]) -> tuple[int, str]:
        query = urllib.parse.urlencode({**params, **({"apikey": key} if key else {})})
        target = f"{root}/{path.lstrip('/')}" + (f"?{query}" if query else "")
        try:
            with urllib.request.urlopen(urllib.request.Request(target, headers={"User-Agent": "tidewright"}), timeout=timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, ""
        except OSError:
            return 0, ""

    return call


def fetched(requests: DataFrame, transport: Transport, concurrency: int = 8, raw: bool = False) -> DataFrame:
    """``requests`` (path, params map<string,string>, ...) with ``body`` or ``error`` of each answer.

    The requests are dealt over ``concurrency`` tasks; each paces itself so that all together keep the
    provider's pace. A failed request is a row with an error, never a failed job. raw: the body need
    not be JSON. A retried task asks again, so requests must be safe to repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Provider(transport, spread=concurrency)
        for batch in batches:
            bodies: list[str | None] = []
            errors: list[str | None] = []
            for path, params in zip(batch["path"].to_pylist(), batch["params"].to_pylist(), strict=True):
                try:
                    text = client.text(path, dict(params or []))
                    if not raw:
                        json.loads(text)
                except (ProviderError, ValueError, OSError) as e:
                    text, error = None, str(e)
                else:
                    error = None
                bodies.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, "body", "error"])

    schema = StructType([*requests.schema.fields, StructField("body", StringType()), StructField("error", StringType())])
    return requests.repartition(concurrency).mapInArrow(run, schema)


def batched(symbols: DataFrame, size: int = QUOTE_BATCH) -> DataFrame:
    """(path, params): quote requests for the column ``symbol``, at most ``size`` symbols each."""
    few = symbols.select("symbol").distinct().groupBy(F.pmod(F.xxhash64("symbol"), F.lit(1024)).alias("part")).agg(F.sort_array(F.collect_list("symbol")).alias("own"))
    cut = F.transform(F.sequence(F.lit(1), F.size("own"), F.lit(size)), lambda i: F.slice("own", i, size))
    return few.select(F.explode(cut).alias("own")).select(F.lit("batch-quote").alias("path"), F.create_map(F.lit("symbols"), F.array_join("own", ",")).alias("params"))
