"""Settings of an index, from keywords, a dictionary, the session's ``termloom.*`` settings or a properties file."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from typing import Any, TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def parameter(given: Mapping[str, str], name: str, default: T, parse: Callable[[str], T]) -> T:
    """``given[name]`` as parsed; the default where it is missing or, with a warning, can't be parsed."""
    if name not in given:
        return default
    try:
        return parse(given[name])
    except Exception as e:  # noqa: BLE001 - whatever the parser raises
        logging.getLogger(__name__).warning("%s=%r can't be read, %r is used: %s", name, given[name], default, e)
        return default


def _flag(x: str) -> bool:
    try:
        return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[x.strip().lower()]
    except KeyError:
        raise ValueError("not a truth value") from None


@dataclass(frozen=True)
class Config:
    #: Format of the tables: any that Spark reads and writes by columns.
    format: str = "parquet"
    #: Streams commit by themselves each ``flush_interval`` seconds; else they take what there is and stop.
    auto_flush: bool = True
    flush_interval: float = 30.0
    #: Seconds that ``close`` waits for searches that are running, and for which ``vacuum`` keeps what an older manifest names.
    wait_on_close: float = 1.0
    keep_old: float = 0.0
    #: Files that the sorted postings of a generation are written to; 0 for the session's shuffle width.
    width: int = 0
    #: Documents of a block, postings of a segment, documents of a range of deleted ones.
    block: int = 1 << 16
    segment: int = 64
    bitmap: int = 32767
    #: Generations of fewer postings are merged once there are ``merge_count`` of them; one with a share of live documents
    #: below ``1 / compaction_factor`` is rewritten; a merge takes up to ``merge_most`` postings, or one generation.
    merge_small: int = 1_000_000
    merge_count: int = 8
    merge_most: int = 1_000_000_000
    compaction_factor: float = 2.0
    #: Metrics: logged or not, rates by second or minute, seconds between reports.
    metrics_log: bool = True
    metrics_per_second: bool = True
    metrics_interval: float = 60.0
    #: Parameters of the Okapi measure.
    k1: float = 1.2
    b: float = 0.75
    average_length: float = 1000.0

    @classmethod
    def of(cls, given: Mapping[str, Any]) -> Config:
        """Settings by name, as text or as values; unknown names are passed over, what can't be parsed is the default."""
        parse = {"bool": _flag, "int": int, "float": float, "str": str}
        text = {k: str(v) for k, v in given.items()}
        return cls(**{f.name: parameter(text, f.name, f.default, parse[f.type]) for f in fields(cls)})

    @classmethod
    def from_session(cls, spark: SparkSession) -> Config:
        """Of the settings ``termloom.<name>`` as they are now: each call reads them again."""
        return cls.of({f.name: v for f in fields(cls) if (v := spark.conf.get(f"termloom.{f.name}", None)) is not None})

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Config:
        """Of lines ``name = value``; ``#`` begins a comment."""
        lines = (r.value.split("#", 1)[0] for r in spark.read.text(path).collect())
        return cls.of({k.strip().removeprefix("termloom."): v.strip() for x in lines if "=" in x for k, v in [x.split("=", 1)]})
