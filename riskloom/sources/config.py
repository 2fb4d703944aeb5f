"""Configuration: dataset registry, thresholds, runtime options."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import lru_cache

from .. import taxonomy as T


@dataclass(frozen=True)
class DatasetSpec:
    """One source of the registry."""

    name: str
    kind: str = "generic"
    loader: str = "local"
    enabled: bool = True
    path: str | None = None
    options: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Thresholds:
    """route / review / block of every scored label; a calibrated table replaces routes only."""

    table: dict = field(default_factory=lambda: dict(T.THRESHOLDS), hash=False)

    def of(self, label: str) -> tuple[float, float, float]:
        return self.table.get(label, T.DEFAULT_THRESHOLDS)

    def calibrated(self, routes: dict[str, float]) -> Thresholds:
        return Thresholds({x: (routes.get(x, self.of(x)[0]), *self.of(x)[1:]) for x in T.SCORED})

    def as_dict(self) -> dict[str, dict[str, float]]:
        return {x: dict(zip(("route", "review", "block"), self.of(x))) for x in T.SCORED}


@dataclass(frozen=True)
class RuntimeConfig:
    """Options of classification with their defaults."""

    full_scan: bool = False
    window_words: int = 128
    long_text_words: int = 200
    toxic_fallback: bool = False
    toxic_band: tuple[float, float] = (0.30, 0.70)
    fast_block: float | None = None


@lru_cache(maxsize=32)
def _read(path: str, stamp: float) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def read_yaml(path: str) -> dict:
    """A YAML file; read again only when it has changed."""
    return _read(path, os.path.getmtime(path))


def write_yaml(path: str, data: dict) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(data, f, sort_keys=False)


def load_specs(path: str, include_disabled: bool = False) -> list[DatasetSpec]:
    """Sources of a registry file (a list under ``datasets``), enabled ones unless asked otherwise."""
    known = {"name", "kind", "loader", "enabled", "path"}
    specs = [DatasetSpec(**{k: v for k, v in d.items() if k in known}, options={k: v for k, v in d.items() if k not in known}) for d in read_yaml(path).get("datasets", [])]
    return [s for s in specs if s.enabled or include_disabled]


def load_thresholds(path: str, calibrated: str | None = None) -> Thresholds:
    """Thresholds of a file (``labels``: route, review, block), overlaid with calibrated routes if that file exists."""
    labels = read_yaml(path).get("labels", {})
    t = Thresholds({x: tuple(float(labels.get(x, {}).get(k, d)) for k, d in zip(("route", "review", "block"), T.THRESHOLDS.get(x, T.DEFAULT_THRESHOLDS))) for x in T.SCORED})
    if calibrated and os.path.exists(calibrated):
        t = t.calibrated({k: float(v["route"] if isinstance(v, dict) else v) for k, v in read_yaml(calibrated).get("labels", {}).items()})
    return t


def write_routes(path: str, routes: dict[str, float], sweep: dict[str, list[dict]] | None = None) -> None:
    """A file of calibrated routes (``labels``: route) that ``load_thresholds`` overlays; the sweep is kept beside them."""
    doc = {"labels": {k: {"route": float(v)} for k, v in routes.items()}}
    write_yaml(path, doc | ({"sweep": sweep} if sweep else {}))


def load_runtime(path: str) -> RuntimeConfig:
    got = read_yaml(path)
    names = RuntimeConfig.__dataclass_fields__
    return RuntimeConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items() if k in names})


# Kinds of model artefacts, the preferred ones first.
MODEL_KINDS = ["finetuned", "int8", "onnx", "local", "hub"]


def model_source(places: dict[str, str | None]) -> tuple[str, str] | None:
    """(kind, place) of the preferred artefact that is there; a hub name needs no file."""
    for kind in MODEL_KINDS:
        place = places.get(kind)
        if place and (kind == "hub" or os.path.exists(place)):
            return kind, place
    return None
