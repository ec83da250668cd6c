"""Settings from a dict, a JSON or simple YAML file and the environment, later ones winning."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

from factloom.plans.planner import PROFILES

PREFIX = "FACTLOOM_"


@dataclass(frozen=True)
class Config:
    store: str = "facts"
    profile: str = "default"
    shuffle_partitions: int = 0  # 0 leaves Spark's own
    seed: int = 42
    most_rows: int = 10_000

    def __post_init__(self):
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}")
        if self.shuffle_partitions < 0 or self.most_rows < 1:
            raise ValueError("shuffle_partitions is not negative and most_rows is positive")

    def spark_settings(self) -> dict[str, str]:
        out = dict(PROFILES[self.profile])
        if self.shuffle_partitions:
            out["spark.sql.shuffle.partitions"] = str(self.shuffle_partitions)
        return out

    def as_dict(self) -> dict:
        return asdict(self)


def _typed(name: str, value):
    kind = {f.name: type(f.default) for f in fields(Config)}.get(name)
    if kind is None:
        raise ValueError(f"unknown setting {name!r}")
    return kind(value)


def parse(text: str) -> dict:
    """A JSON object, or ``key: value`` lines."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            k, colon, v = line.partition(":")
            if not colon:
                raise ValueError(f"cannot read {line!r}")
            out[k.strip()] = v.strip().strip("'\"")
    return out


def load(path: str | None = None, environ: Mapping[str, str] | None = None, **given) -> Config:
    environ = os.environ if environ is None else environ
    values = {}
    if path:
        with open(path) as f:
            values |= parse(f.read())
    values |= {k[len(PREFIX) :].lower(): v for k, v in environ.items() if k.startswith(PREFIX)}
    values |= given
    return replace(Config(), **{k: _typed(k, v) for k, v in values.items()})
