"""Run configuration: YAML that may extend another file, overridden by arguments; areas from GeoJSON."""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from scenespark import presets as P


@dataclass(frozen=True)
class Thresholds:
    ndsi_light: float = P.NDSI_LIGHT
    ndsi_solid: float = P.NDSI_SOLID
    ndwi: float = P.NDWI_WATER
    vis_bright_min: float = P.VIS_BRIGHT_MIN
    nir_bright_min: float = P.NIR_BRIGHT_MIN
    nodata_fraction: float = P.NODATA_SHARE


@dataclass(frozen=True)
class RunConfig:
    start: str | None = None
    end: str | None = None
    area: tuple[float, float, float, float] | None = None
    output: str = "out"
    max_tiles: int | None = None
    thresholds: Thresholds = field(default_factory=Thresholds)


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Nested dictionaries are merged, all else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_yaml(path: str | Path, _seen: tuple[Path, ...] = ()) -> dict[str, Any]:
    """A mapping; `extends` names a file beside it that it is merged over. Circles are an error."""
    try:
        import yaml
    except ImportError as e:  # the only use of the library
        raise RuntimeError("reading YAML needs PyYAML") from e
    path = Path(path).resolve()
    if path in _seen:
        raise ValueError(f"{path} extends itself")
    data = yaml.safe_load(path.read_text()) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} is not a mapping")
    parent = data.pop("extends", None)
    return merge(load_yaml(path.parent / parent, (*_seen, path)), data) if parent else data


def build(data: dict[str, Any] | None = None, **overrides: Any) -> RunConfig:
    """Defaults, then data, then overrides that aren't None; names of thresholds may be given flat. Arguments
    always win, whether a file is given or not. Unknown names are an error."""
    data = dict(data or {})
    names, flat = {f.name for f in fields(RunConfig)}, {f.name for f in fields(Thresholds)}
    given = {k: v for k, v in overrides.items() if v is not None}
    if unknown := (set(data) | set(given)) - names - flat:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    cuts = merge(asdict(Thresholds()), {**data.pop("thresholds", {}), **{k: data.pop(k) for k in list(data) if k in flat}})
    cuts |= {k: given.pop(k) for k in list(given) if k in flat}
    if isinstance(given.get("thresholds"), Thresholds):
        cuts = asdict(given.pop("thresholds"))
    config = replace(RunConfig(**data), **given)
    return replace(config, thresholds=Thresholds(**cuts), area=tuple(config.area) if config.area else None)


def geometry(text: str) -> dict[str, Any]:
    """The polygon of a GeoJSON feature collection (its first feature), feature or geometry."""
    g = json.loads(text)
    if g.get("type") == "FeatureCollection":
        if not g.get("features"):
            raise ValueError("an empty feature collection")
        g = g["features"][0]
    if g.get("type") == "Feature":
        g = g["geometry"]
    if not g or g.get("type") not in ("Polygon", "MultiPolygon"):
        raise ValueError("a polygon is needed")
    return g


def bounds(geom: dict[str, Any]) -> tuple[float, float, float, float]:
    """West, south, east, north of all coordinates."""
    points: list[tuple[float, float]] = []

    def walk(x: Any) -> None:
        if isinstance(x[0], (int, float)):
            points.append((float(x[0]), float(x[1])))
        else:
            for y in x:
                walk(y)

    walk(geom["coordinates"])
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)
