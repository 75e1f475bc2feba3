"""Statistics of stages: records, sums and the older report format."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ("input_num", "input_bytes", "input_chars", "output_num", "output_bytes", "output_chars", "discard_num", "diff_bytes", "diff_chars", "errors")


TIME = "cumulative_time_ns"


@dataclass
class Statistics:
    name: str | None = None
    input_num: int = 0
    input_bytes: int = 0
    input_chars: int = 0
    output_num: int = 0
    output_bytes: int = 0
    output_chars: int = 0
    discard_num: int = 0
    diff_bytes: int = 0
    diff_chars: int = 0
    cumulative_time_ns: int = 0
    errors: int = 0

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def update(self, other: Statistics) -> None:
        for f in fields(self)[1:]:
            setattr(self, f.name, getattr(self, f.name) + getattr(other, f.name))

    def reset(self) -> Statistics:
        for f in fields(self)[1:]:
            setattr(self, f.name, 0)
        return self

    @staticmethod
    def add(x: Statistics, y: Statistics) -> Statistics:
        if x.name != y.name:
            raise AssertionError("statistics of different stages")
        out = Statistics(x.name)
        out.update(x)
        out.update(y)
        return out

    @staticmethod
    def add_list_of_stats(x: list[Statistics], y: list[Statistics]) -> list[Statistics]:
        """Sums by name, in the order of x."""
        other = {s.name: s for s in y}
        if {s.name for s in x} != set(other):
            raise ValueError("the lists have different names")
        return [Statistics.add(s, other[s.name]) for s in x]

    @staticmethod
    def get_filter(name: str, stats: list[Statistics]) -> Statistics:
        for s in stats:
            if s.name == name:
                return s
        raise KeyError(name)


def merge(*parts: DataFrame) -> DataFrame:
    """Statistics DataFrames of several runs added up by name (partial and final sums are Spark's)."""
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def legacy_report(stats: Iterable[Statistics]) -> dict[str, Any]:
    """The older layout: total_info and layers_info.  Sizes in and out are in 10^6 bytes, differences in 2^20."""
    total, *layers = list(stats)
    return {
        "total_info": {
            "processed_num": total.input_num, "discard_num": total.discard_num, "input_MB": total.input_bytes / 1e6, "output_MB": total.output_bytes / 1e6,
            "cumulative_time": total.cumulative_time_ns / 1e9, "total_token_num": total.input_chars,
        },
        "layers_info": [{"name": s.name, "discard_num": s.discard_num, "diff_MB": s.diff_bytes / (1 << 20), "cumulative_time": s.cumulative_time_ns / 1e9, "params": {}} for s in layers],
    }


def dump(stats: Iterable[Statistics], indent: int | None = None) -> str:
    return json.dumps([s.to_dict() for s in stats], ensure_ascii=False, indent=indent)
