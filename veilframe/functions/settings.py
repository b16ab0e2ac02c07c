"""Saved settings: JSON over defaults, and what a scan takes from them."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.scan import ScanConfig
from .arrays import bound
from .rules import CATEGORIES

#: The categories that have a switch; faces have their own, custom rules none.
SWITCHES = tuple(c for c in CATEGORIES if c not in ("face", "custom"))
DEFAULTS = {"enabled": dict.fromkeys(SWITCHES, True), "faces": True, "min_confidence": 0.0}
#: The floor's slider.
FLOOR_MAX, FLOOR_STEP = 0.95, 0.05


def merge(saved: Column) -> Column:
    """Settings from a JSON column: saved values over defaults; absent or corrupt JSON, and values of another type, give the defaults."""
    defaults = F.create_map(*[F.lit(x) for kv in DEFAULTS["enabled"].items() for x in kv])

    def merged(v):
        part = lambda path: F.try_variant_get(v, path, "variant")
        flag = lambda x: F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        own = F.try_variant_get(v, "$.enabled", "map<string,variant>")
        enabled = F.transform_values(F.coalesce(own, F.create_map().cast("map<string,variant>")), lambda k, x: flag(x))
        both = F.map_zip_with(defaults, enabled, lambda k, d, s: F.coalesce(s, d))
        number = bound(part("$.minConfidence"), lambda x: F.when(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(x, "$", "double")))
        faces = bound(part("$.faces"), flag)
        return F.struct(both.alias("enabled"), F.coalesce(faces, F.lit(DEFAULTS["faces"])).alias("faces"), F.coalesce(number, F.lit(DEFAULTS["min_confidence"])).alias("min_confidence"))

    return bound(F.try_parse_json(saved), merged)


def load(saved: str | None) -> dict:
    """The same on the driver, for one user's settings."""
    try:
        got = json.loads(saved or "{}")
    except ValueError:
        got = {}
    got = got if isinstance(got, dict) else {}
    own = got.get("enabled") if isinstance(got.get("enabled"), dict) else {}
    floor = got.get("minConfidence")
    return {
        "enabled": DEFAULTS["enabled"] | {k: v for k, v in own.items() if isinstance(v, bool)},
        "faces": got["faces"] if isinstance(got.get("faces"), bool) else DEFAULTS["faces"],
        "min_confidence": float(floor) if isinstance(floor, (int, float)) and not isinstance(floor, bool) else DEFAULTS["min_confidence"],
    }


def save(settings: dict) -> str:
    return json.dumps({"enabled": settings["enabled"], "faces": settings["faces"], "minConfidence": settings["min_confidence"]})


def to_config(settings: dict) -> ScanConfig:
    """Switches and floor; custom rules don't come from settings."""
    return ScanConfig(enabled=dict(settings["enabled"]), min_confidence=settings["min_confidence"])


def check(settings: dict) -> None:
    unknown = set(settings["enabled"]) - set(CATEGORIES)
    if unknown:
        raise ValueError(f"no such categories: {sorted(unknown)}")
    if not 0 <= settings["min_confidence"] <= FLOOR_MAX:
        raise ValueError(f"the floor must lie between 0 and {FLOOR_MAX}")
    if abs(settings["min_confidence"] / FLOOR_STEP - round(settings["min_confidence"] / FLOOR_STEP)) > 1e-6:
        raise ValueError(f"the floor moves in steps of {FLOOR_STEP}")
