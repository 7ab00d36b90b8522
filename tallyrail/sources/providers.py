"""Provider interface for generation and evaluation, and plugins as data sources.

A provider turns a batch of requests into rows; models, compilers and runners are
such providers and stay outside. A failing batch gives a failure row per member.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GENERATION = "sample_id string, success boolean, code string, reason string, detail string"
EVIDENCE = "sample_id string, compile_pass boolean, link_pass boolean, behavioral_pass boolean, reason string, tests_total int, tests_passed int, detail string"
Provider = Callable[[pd.DataFrame], pd.DataFrame]


def load(name: str, allowed: tuple[str, ...]) -> object:
    """Object of ``module:object`` from an allow-listed module."""
    module, _, attribute = name.partition(":")
    if module.split(".")[0] not in allowed or not attribute:
        raise ValueError(f"{name!r} is not an allowed plugin")
    return getattr(importlib.import_module(module), attribute)


def generate(requests: DataFrame, make: Callable[[], Provider], batch_size: int = 64) -> DataFrame:
    """Generations of all requests; the provider is made once per task."""
    return _run(requests, make, GENERATION, batch_size, {"success": False, "reason": "backend_error"})


def evaluate(candidates: DataFrame, make: Callable[[], Provider], batch_size: int = 64) -> DataFrame:
    """Evidence of all candidates."""
    return _run(candidates, make, EVIDENCE, batch_size, {"compile_pass": False, "link_pass": False, "behavioral_pass": False, "reason": "evaluation_error", "tests_total": 0, "tests_passed": 0})


EMBEDDING = "id long, vector array<double>, reason string, detail string"


def embed(texts: DataFrame, make: Callable[[], Provider], batch_size: int = 64) -> DataFrame:
    """Vectors of all texts (id, text); the provider answers (id, vector) for a batch. A failing batch gives null vectors and a reason."""
    return _run(texts, make, EMBEDDING, batch_size, {"vector": None, "reason": "embedding_error"}, "id")


def retried(make: Callable[[], Provider], column: str, attempts: int = 3, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[], Provider]:
    """A provider that is asked again, ``attempts`` times in all, for rows whose ``column`` it left empty, and after an error.

    Between two attempts it waits, ``base`` seconds at first and twice as long each
    time, up to ``most``. Rows that stay empty are given back as they are; the last error is raised.
    """

    def made() -> Provider:
        provider = make()

        def ask(pdf: pd.DataFrame) -> pd.DataFrame:
            key, done, left, why = pdf.columns[0], [], pdf, None
            for attempt in range(attempts):
                if attempt:
                    sleep(min(base * 2 ** (attempt - 1), most))
                try:
                    got, why = provider(left), None
                except Exception as error:  # noqa: BLE001  any error is worth another attempt, and is raised at the end
                    why = error
                    continue
                empty = got[column].isna() | (got[column].astype(str).str.strip() == "")
                last = attempt == attempts - 1
                done.append(got if last else got[~empty])
                left = left[left[key].isin(got[empty][key])]
                if last or not len(left):
                    break
            if why is not None:
                raise why
            return pd.concat(done, ignore_index=True)

        return ask

    return made


def _run(df: DataFrame, make: Callable[[], Provider], schema: str, size: int, failed: dict, key: str = "sample_id") -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                try:
                    got = provider(part)
                    if sorted(got[key]) != sorted(part[key]):
                        raise ValueError("a provider must answer each request once")
                except Exception as why:  # noqa: BLE001  a provider's failure is a result, with what went wrong
                    row = failed | {"detail": f"{type(why).__name__}: {why}"[-2000:]}
                    got = pd.DataFrame({key: part[key].to_numpy(), **{k: [v] * len(part) for k, v in row.items()}})
                got = got.reindex(columns=names).astype(object)
                yield got.where(got.notna(), None)

    return df.mapInPandas(run, schema)


def case_outcomes(passed: list[bool | None]) -> tuple[int, int, str | None]:
    """(total, passed, reason) of a candidate's test cases; no case at all is a failure, the first failure names the reason."""
    if not passed:
        return 0, 0, "no_tests"
    ok = [p is True for p in passed]
    first = next((p for p in passed if p is not True), True)
    return len(ok), sum(ok), None if first is True else "test_mismatch" if first is False else "test_error"


class SampleSource(DataSource):
    """Samples of a plugin: option ``plugin`` names a function that returns (sample_id, text) pairs for a part out of ``parts``."""

    @classmethod
    def name(cls) -> str:
        return "sample_plugin"

    def schema(self) -> str:
        return "sample_id string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.plugin, self.parts, self.allowed = options["plugin"], int(options.get("parts", "1")), tuple(options.get("allowed", "").split(","))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from load(self.plugin, self.allowed)(partition.value, self.parts)
