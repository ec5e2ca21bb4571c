"""Hooks for what stays outside the engine: decoding, speech detection, recognition, downloading.

Each hook is a plain function on one item or batch; the engine runs it inside
``mapInPandas`` with the provider made once per task, retries a failed item
alone, and keeps errors as rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

BATCH_SIZE = 4
ATTEMPTS = 2


class Provider(Protocol):
    """Recognises prepared items; ``identity`` names every parameter that affects the output."""

    def identity(self) -> dict: ...

    def transcribe_batch(self, items: Sequence[dict]) -> Sequence[str]: ...


def run_provider(df: DataFrame, keys: Sequence[str], make: Callable[[], Provider], *, batch_size: int = BATCH_SIZE, attempts: int = ATTEMPTS) -> DataFrame:
    """keys, payload, error, elapsed for every row.

    Rows go to the provider in batches; a batch that fails is tried item by
    item, each item up to ``attempts`` times, and an item that still fails
    keeps its error without failing the others.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = None
        for frame in frames:
            rows = frame.to_dict("records")
            out = []
            for at in range(0, len(rows), batch_size):
                if provider is None:
                    provider = make()
                batch = rows[at : at + batch_size]
                began = time.monotonic()
                try:
                    found = list(provider.transcribe_batch(batch))
                    if len(found) != len(batch):
                        raise ValueError(f"{len(found)} results for {len(batch)} items")
                    spent = (time.monotonic() - began) / len(batch)
                    out += [(r, p, None, spent) for r, p in zip(batch, found, strict=True)]
                except Exception:
                    out += [_alone(provider, r, attempts) for r in batch]
            result = pd.DataFrame([[r[k] for k in keys] + [p, e, s] for r, p, e, s in out], columns=[*keys, "payload", "error", "elapsed"])
            yield result

    return df.mapInPandas(run, f"{kinds}, payload string, error string, elapsed double")


def _alone(provider: Provider, row: dict, attempts: int) -> tuple:
    began, error = time.monotonic(), ""
    for _ in range(attempts):
        try:
            (found,) = provider.transcribe_batch([row])
            return row, found, None, time.monotonic() - began
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
    return row, None, error, time.monotonic() - began


def map_content(files: DataFrame, keys: Sequence[str], fn: Callable[[bytes], object], result: str, name: str = "value") -> DataFrame:
    """Apply a decoder or detector to each file's ``content``; keys, the result (of SQL type ``result``), and an error."""
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    out.append([*(row[k] for k in keys), fn(bytes(row["content"])), None])
                except Exception as e:
                    out.append([*(row[k] for k in keys), None, f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(out, columns=[*keys, name, "error"])

    return files.select(*keys, "content").mapInPandas(run, f"{kinds}, `{name}` {result}, error string")


def benchmark(items: Sequence, work: Callable[[object], object]) -> list[dict]:
    """Elapsed seconds or the error of each item; a failure does not stop the run."""
    out = []
    for item in items:
        began = time.monotonic()
        try:
            work(item)
            out.append({"item": str(item), "error": None, "elapsed_seconds": round(time.monotonic() - began, 3)})
        except Exception as e:
            out.append({"item": str(item), "error": f"{type(e).__name__}: {e}", "elapsed_seconds": round(time.monotonic() - began, 3)})
    return out
