"""Settings of a comparison as files, plug-ins by name, and runs that can be watched and cancelled."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.keys import OTHER_TOKENS, STRUCTURE_TOKENS, TABLE_LAYERS, TABLE_WORDS, TITLE_LAYERS


def _known(cls, values: dict) -> dict:
    return {f.name: values[f.name] for f in fields(cls) if f.name in values and values[f.name] is not None}


@dataclass(frozen=True)
class NoiseSettings:
    """What a comparison suppresses; kept as JSON, unknown names do not count."""

    global_alignment: bool = True
    optimal_most: int = 200
    cosmetic_detection: bool = True
    suppress_cosmetic_only: bool = False
    cosmetic_attributes: tuple[str, ...] = ("color", "lineweight", "linetype")
    min_changes_per_zone: int = 1

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> NoiseSettings:
        try:
            own = _known(cls, json.loads(text))
        except (ValueError, TypeError, AttributeError):
            return cls()
        if "cosmetic_attributes" in own:
            own["cosmetic_attributes"] = tuple(own["cosmetic_attributes"])
        return replace(cls(), **own)


@dataclass(frozen=True)
class RegionProfile:
    """Layer patterns and words that tell frames, titles, tables and structure apart; a YAML file gives some of them."""

    name: str = "default"
    title_layer_patterns: tuple[str, ...] = tuple(TITLE_LAYERS)
    table_layer_patterns: tuple[str, ...] = tuple(TABLE_LAYERS)
    table_reject_keywords: tuple[str, ...] = TABLE_WORDS
    structural_layer_tokens: tuple[str, ...] = STRUCTURE_TOKENS
    nonstructural_layer_tokens: tuple[str, ...] = OTHER_TOKENS

    @classmethod
    def from_yaml(cls, text: str) -> RegionProfile:
        import yaml

        data = yaml.safe_load(text) or {}
        if not isinstance(data, dict):
            raise ValueError("a region profile is a mapping")
        own = _known(cls, data)
        return replace(cls(), **{k: v if k == "name" else (v,) if isinstance(v, str) else tuple(str(x) for x in v if str(x).strip()) for k, v in own.items()})


@dataclass
class Registry:
    """Plug-ins by name; the first that says it can, or the one asked for."""

    held: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, plug_in: Callable) -> None:
        self.held[name] = plug_in

    def get(self, name: str) -> Callable:
        if name not in self.held:
            raise KeyError(f"unknown plug-in {name}; there are {sorted(self.held)}")
        return self.held[name]


#: Readers of a folder by the kind of its files, and functions that turn a text column into vectors.
READERS, EMBEDDINGS = Registry(), Registry()


def read_kind(spark: SparkSession, kind: str, folder: str) -> DataFrame:
    """A folder through the reader registered for the kind."""
    return READERS.get(kind)(spark, folder)


def embedded(text: Column, backend: str) -> Column:
    """Vectors of a text by the backend registered."""
    return EMBEDDINGS.get(backend)(text)


def hashed_vector(text: Column, width: int = 64) -> Column:
    """A text's words as counts by hash: a backend that needs no model."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width)))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))


EMBEDDINGS.add("hashed", hashed_vector)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], list[str]]]:
    """Jobs started inside carry a tag; what it gives cancels all of them, from any thread."""
    spark.addTag(tag)
    try:
        yield lambda: list(spark.interruptTag(tag))
    finally:
        spark.removeTag(tag)


class Progress:
    """Stages with weights: each report is (share done, stage) to a callback; a callback that gives True ends the run."""

    def __init__(self, stages: Sequence[tuple[str, float]], report: Callable[[float, str], bool | None]):
        self.stages, self.report, self.done = dict(stages), report, 0.0
        self.total = sum(self.stages.values()) or 1.0

    def finish(self, stage: str) -> None:
        self.done += self.stages[stage]
        if self.report(self.done / self.total, stage):
            raise InterruptedError(f"cancelled after {stage}")
