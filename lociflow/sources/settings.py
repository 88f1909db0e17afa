"""Scientific settings: a strict TOML file, its ranges, and its identity."""

from __future__ import annotations

import hashlib
import os
import tomllib
from dataclasses import dataclass, field, fields

SCHEMA_VERSION = 5
MAX_BYTES = 1 << 20


class SettingsError(ValueError):
    pass


def _ranged(default, test, said: str):
    return field(default=default, metadata={"test": test, "said": said})


_positive = (lambda v: v > 0, "greater than 0")
_negative = (lambda v: v < 0, "less than 0")
_share = (lambda v: 0 < v <= 1, "in (0, 1]")


@dataclass(frozen=True)
class Reference:
    topology: str = _ranged("circular", lambda v: v in ("linear", "circular"), "linear or circular")


@dataclass(frozen=True)
class Basecalling:
    secondary_peak_ratio: float = _ranged(0.33, *_share)


@dataclass(frozen=True)
class NoiseWindows:
    window_size_bases: int = _ranged(10, lambda v: 5 <= v <= 10, "in 5..10")
    minimum_primary_snr: float = _ranged(3.0, *_positive)
    minimum_noisy_windows: int = _ranged(2, lambda v: v >= 2, "2 at least")


@dataclass(frozen=True)
class QualityControl:
    trim_window_size: int = _ranged(10, *_positive)
    best_section_fraction: float = _ranged(0.10, *_share)
    max_relative_quality_score: int = _ranged(60, lambda v: 0 < v <= 255, "in 1..255")
    trim_stringency: float = _ranged(7.0, lambda v: 0 <= v <= 9, "in 0..9")
    minimum_retained_bases: int = _ranged(20, *_positive)


@dataclass(frozen=True)
class AlignmentSettings:
    match_score: int = _ranged(3, *_positive)
    mismatch_score: int = _ranged(-5, *_negative)
    ambiguous_score: int = _ranged(0, lambda v: True, "any")
    gap_open_score: int = _ranged(-10, *_negative)
    gap_extension_score: int = _ranged(-4, *_negative)
    minimum_callable_bases: int = _ranged(20, *_positive)
    minimum_identity: float = _ranged(0.80, lambda v: 0 <= v <= 1, "in 0..1")


@dataclass(frozen=True)
class SampleReconciliation:
    minimum_comparable_bases: int = _ranged(25, *_positive)
    minimum_overlap_agreement: float = _ranged(0.50, lambda v: 0 <= v <= 1, "in 0..1")


@dataclass(frozen=True)
class VariantCalling:
    max_indel_length: int = _ranged(50, lambda v: 1 <= v <= 50, "in 1..50")
    minimum_peak_height: int = _ranged(150, lambda v: 1 <= v <= 32767, "in 1..32767")
    relative_quality_threshold: int = _ranged(30, lambda v: v >= 0, "0 at least")
    regions: tuple = _ranged(((16024, 16365), (73, 340), (438, 576)), lambda v: v and all(len(r) == 2 and 1 <= r[0] <= r[1] for r in v), "inclusive ranges from 1")


@dataclass(frozen=True)
class Settings:
    reference: Reference = Reference()
    basecalling: Basecalling = Basecalling()
    noise_windows: NoiseWindows = NoiseWindows()
    quality_control: QualityControl = QualityControl()
    alignment: AlignmentSettings = AlignmentSettings()
    sample_reconciliation: SampleReconciliation = SampleReconciliation()
    variant_calling: VariantCalling = VariantCalling()
    sha256: str = ""


#: What the settings file calls a section that has another name here. Fixed values.
SECTIONS = {"noise_windows": "signal_processing"}


def parse(data: bytes) -> Settings:
    """Every section and key must be there, no other may, and each value must be of its kind and in its range."""
    if len(data) > MAX_BYTES:
        raise SettingsError(f"{len(data)} bytes; at most {MAX_BYTES}")
    try:
        said = tomllib.loads(data.decode("utf-8"))
    except (UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise SettingsError(str(e)) from e
    if said.pop("schema_version", None) != SCHEMA_VERSION:
        raise SettingsError(f"schema_version must be {SCHEMA_VERSION}")
    parts = {f.name: f for f in fields(Settings) if f.name != "sha256"}
    for ours, name in SECTIONS.items():
        if ours in said:
            raise SettingsError(f"sections differ: {[ours]}")
        if name in said:
            said[ours] = said.pop(name)
    if set(said) != set(parts):
        raise SettingsError(f"sections differ: {sorted(set(said) ^ set(parts))}")
    out = {}
    for name, part in parts.items():
        kind = type(part.default)
        known = {f.name: f for f in fields(kind)}
        if set(said[name]) != set(known):
            raise SettingsError(f"keys of {name} differ: {sorted(set(said[name]) ^ set(known))}")
        values = {}
        for key, f in known.items():
            v = said[name][key]
            if isinstance(v, list):
                v = tuple(map(tuple, v))
            if isinstance(f.default, float) and type(v) is int:
                v = float(v)
            if type(v) is not type(f.default) or v != v or not f.metadata["test"](v):
                raise SettingsError(f"{name}.{key} = {v!r} must be {f.metadata['said']}")
            values[key] = v
        out[name] = kind(**values)
    if out["variant_calling"].relative_quality_threshold >= out["quality_control"].max_relative_quality_score:
        raise SettingsError("variant_calling.relative_quality_threshold must be below the greatest score")
    return Settings(**out, sha256=hashlib.sha256(data).hexdigest())


def load(path: str | None = None) -> Settings:
    """From a path, else from LOCIFLOW_CONFIG, else the defaults."""
    path = path or os.environ.get("LOCIFLOW_CONFIG")
    if path is None:
        return Settings()
    with open(path, "rb") as x:
        return parse(x.read(MAX_BYTES + 1))
