"""Tone mapper settings: frozen records, neutrality, active saturation ranges, XML codec, and a preset folder."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, fields, is_dataclass, replace
from pathlib import Path

from ..functions.pixel import saturation_multiplier

_INSTANCE = "http://www.w3.org/2001/XMLSchema-instance"
_TYPE = f"{{{_INSTANCE}}}type"
#: Differences up to this are none.
EPSILON = 1e-5


def same(a: float, b: float) -> bool:
    return abs(a - b) <= EPSILON


@dataclass(frozen=True)
class Range:
    hue_min: float = 0.0
    hue_max: float = 360.0
    saturation_min: float = 0.0
    saturation_max: float = 1.0
    value_min: float = 0.0
    value_max: float = 1.0
    saturation_multiplier: float = 0.0


@dataclass(frozen=True)
class Filter:
    """Named ranges; an adjustment of the filter stands in for those of its ranges."""

    name: str = ""
    description: str = ""
    enabled: bool = True
    saturation_adjustment: float = 0.0
    ranges: tuple[Range, ...] = ()


# The built-in filters, off by default.
SKIN = Filter("Skin", "Less saturation where hues are those of skin.", False, -30.0, (
    Range(0.0, 50.0, 0.12, 0.85, 0.20, 1.00, -30.0),
    Range(355.0, 18.0, 0.10, 0.70, 0.25, 1.00, -30.0),
    Range(18.0, 38.0, 0.08, 0.65, 0.18, 0.95, -30.0),
))
GRAY = Filter("Gray color", "Less saturation where colours are nearly gray.", False, -55.0, (Range(0.0, 360.0, 0.0, 0.18, 0.05, 0.95, -55.0),))


@dataclass(frozen=True)
class Color:
    red: float = 1.0
    green: float = 1.0
    blue: float = 1.0


@dataclass(frozen=True)
class Lab:
    """Adjustments of the last stage, in Lab; every default is neutral."""

    exposure: float = 0.0
    brightness: float = 1.0
    shadows: float = 1.0
    midtones: float = 1.0
    highlights: float = 1.0
    contrast: float = 1.0
    vibrance: float = 1.0

    def is_neutral(self, epsilon: float = EPSILON) -> bool:
        return all(abs(getattr(self, f.name) - f.default) <= epsilon for f in fields(self))

    def combine(self, other: Lab) -> Lab:
        """Exposures add up, the others multiply."""
        return Lab(self.exposure + other.exposure, **{f.name: getattr(self, f.name) * getattr(other, f.name) for f in fields(self)[1:]})


@dataclass(frozen=True)
class Settings:
    """What all mappers share; every default is neutral."""

    auto_adjust_enabled: bool = False
    exposure_ev: float = 0.0
    brightness: float = 1.0
    contrast: float = 1.0
    shadows_boost: float = 1.0
    midtones_boost: float = 1.0
    highlights_boost: float = 1.0
    dehaze: float = 0.0
    local_contrast: float = 0.0
    local_contrast_radius: int = 1
    transparent: float = 0.0
    saturation: float = 0.0
    saturate_excludes: tuple[Range, ...] = ()
    saturation_filter_presets_directory: str = ""
    saturation_filters: tuple[Filter, ...] = ()
    skin_filter: Filter = SKIN
    gray_color_filter: Filter = GRAY
    gamma: float = 1.0
    color_temperature: float = 6500.0
    white_balance_reference_type: str = "None"
    white_balance_reference_color: Color = Color()
    post_process: Lab = Lab()

    def common(self) -> dict:
        return {"ev": self.exposure_ev, "brightness": self.brightness, "contrast": self.contrast, "saturation": self.saturation, "gamma": self.gamma}

    def boosts(self) -> tuple[float, float, float]:
        return self.shadows_boost, self.midtones_boost, self.highlights_boost

    def ranges(self) -> list[tuple]:
        """All ranges that have an effect, as tuples for the saturation operators."""
        return active_ranges((*self.saturation_filters, self.skin_filter, self.gray_color_filter), self.saturate_excludes)

    def common_as_lab(self) -> Lab:
        """The common controls as the Lab stage takes them where no mapper has applied them."""
        return Lab(exposure=self.exposure_ev, brightness=self.brightness, contrast=self.contrast, vibrance=saturation_multiplier(self.saturation))

    def core_neutral(self) -> bool:
        """Would the mapper itself change nothing but by the common controls?"""
        return True

    def is_neutral(self) -> bool:
        """Transparency, the radius of local contrast and the colour of a reference that is not used don't count."""
        return (
            not self.auto_adjust_enabled
            and all(same(getattr(self, k), v) for k, v in (("exposure_ev", 0), ("brightness", 1), ("contrast", 1), ("dehaze", 0), ("local_contrast", 0), ("saturation", 0), ("gamma", 1)))
            and all(same(b, 1) for b in self.boosts())
            and (same(self.color_temperature, 0) or same(self.color_temperature, 6500))
            and self.white_balance_reference_type == "None"
            and not self.ranges()
            and self.post_process.is_neutral()
            and self.core_neutral()
        )


@dataclass(frozen=True)
class AcesSettings(Settings):
    key: float = 0.18

    def core_neutral(self) -> bool:
        return same(self.key, 0.18)


@dataclass(frozen=True)
class NaturalSettings(Settings):
    target_gray: float = 0.24
    white_point_percentile: float = 1.0
    output_mid_gray: float = 0.25
    auto_brightness_compensation: bool = False
    bypass_tone_compression_for_ldr: bool = True
    ldr_bypass_white_point_threshold: float = 3.4028235e38
    tonal_range_compression: float = 4.0

    def core_neutral(self) -> bool:
        return not self.auto_brightness_compensation and self.bypass_tone_compression_for_ldr


@dataclass(frozen=True)
class ContrastSettings(Settings):
    strength: float = 1.0
    tone_compression: float = 1.0
    lighting_effect: float = 1.0
    luminance: float = 1.0
    white_clip: float = 1.0
    black_clip: float = 0.0

    def core_neutral(self) -> bool:
        return same(self.strength, 0) or all(same(v, w) for v, w in ((self.tone_compression, 1), (self.lighting_effect, 1), (self.luminance, 1), (self.white_clip, 1), (self.black_clip, 0)))


@dataclass(frozen=True)
class BrightnessSettings(Settings):
    strength: float = 1.0
    lighting: float = 1.0
    brightness_boost: float = 1.0
    white_clip: float = 1.0
    black_clip: float = 0.0

    def core_neutral(self) -> bool:
        return same(self.strength, 0) or all(same(v, w) for v, w in ((self.lighting, 1), (self.brightness_boost, 1), (self.white_clip, 1), (self.black_clip, 0)))


# Names of the types and elements in settings files.
TYPES = {"AcesFilmicTonemapperSettings": AcesSettings, "NaturalToneMapperSettings": NaturalSettings, "ContrastBalancerToneMapperSettings": ContrastSettings, "BrightnessBalancerToneMapperSettings": BrightnessSettings}
ROOT, ITEMS = "ToneMapperSerializationModel", {"SaturationColorRange": Range, "SaturationColorFilter": Filter}
REFERENCES = ("None", "Auto", "Black", "Gray", "White")


def active_ranges(filters: tuple[Filter, ...], ranges: tuple[Range, ...] = ()) -> list[tuple]:
    """Ranges that have an effect, as tuples for the saturation operator."""
    out = [r for r in ranges if abs(r.saturation_multiplier) > 1e-6]
    for f in filters:
        if f.enabled:
            adjusted = [replace(r, saturation_multiplier=f.saturation_adjustment) for r in f.ranges] if abs(f.saturation_adjustment) > 1e-6 else f.ranges
            out += [r for r in adjusted if abs(r.saturation_multiplier) > 1e-6]
    return [tuple(getattr(r, x.name) for x in fields(Range)) for r in out]


def _element(name: str) -> str:
    return "ExposureEV" if name == "exposure_ev" else "".join(p.capitalize() for p in name.split("_"))


def _write(element: ET.Element, record) -> None:
    names = {kind: name for name, kind in ITEMS.items()}
    for f in fields(record):
        value, child = getattr(record, f.name), ET.SubElement(element, _element(f.name))
        if isinstance(value, tuple):
            for item in value:
                _write(ET.SubElement(child, names[type(item)]), item)
        elif is_dataclass(value):
            _write(child, value)
        else:
            child.text = str(value).lower() if isinstance(value, bool) else str(value)


def _read(element: ET.Element, kind):
    """Elements that are missing keep their defaults; unknown ones are an error, so a file of another shape isn't read as empty."""
    known = {_element(f.name): f for f in fields(kind)}
    given = {}
    for child in element:
        if child.tag not in known:
            raise ValueError(f"{kind.__name__} has no element {child.tag}")
        f = known[child.tag]
        default = getattr(kind(), f.name)
        if isinstance(default, tuple):
            given[f.name] = tuple(_read(x, ITEMS[x.tag]) for x in child)
        elif is_dataclass(default):
            given[f.name] = _read(child, type(default))
        else:
            text = (child.text or "").strip()
            given[f.name] = text == "true" if isinstance(default, bool) else type(default)(text)
    if given.get("white_balance_reference_type", "None") not in REFERENCES:
        raise ValueError(f"unknown white balance reference {given['white_balance_reference_type']}")
    return kind(**given)


def to_xml(settings: Settings) -> str:
    names = {kind: name for name, kind in TYPES.items()}
    root = ET.Element(ROOT)
    _write(ET.SubElement(root, "Settings", {_TYPE: names[type(settings)]}), settings)
    return ET.tostring(root, encoding="unicode")


def from_xml(text: str) -> Settings:
    root = ET.fromstring(text)
    element = root.find("Settings")
    if root.tag != ROOT or element is None or element.get(_TYPE) not in TYPES:
        raise ValueError(f"not a settings file: {root.tag}")
    return _read(element, TYPES[element.get(_TYPE)])


def load_presets(folder: str | None) -> list[Filter]:
    """All filters of a folder in the order of file names; a missing or blank folder has none; the default name is the stem."""
    if not folder or not folder.strip() or not Path(folder).is_dir():
        return []
    found = []
    for path in sorted(Path(folder).glob("*.xml")):
        root = ET.parse(path).getroot()
        if root.tag != "SaturationColorFilter":
            raise ValueError(f"{path} is not a filter but {root.tag}")
        preset = _read(root, Filter)
        found.append(preset if preset.name.strip() else replace(preset, name=path.stem))
    return found


def save_preset(path: str, preset: Filter) -> None:
    root = ET.Element("SaturationColorFilter")
    _write(root, preset)
    Path(path).write_text(ET.tostring(root, encoding="unicode"))
