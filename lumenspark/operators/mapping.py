"""The order in which settings are applied to an image: one chain of steps for any settings, and its DataFrame form."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..functions.dialect import clamp, n, rounded
from ..sources.settings import AcesSettings, BrightnessSettings, ContrastSettings, Lab, NaturalSettings, Settings
from . import steps
from .steps import KEYS, RGB

SOURCE = ("s_r", "s_g", "s_b")


def core(settings: Settings, source: str, hdr: bool, scene: float | str) -> list[tuple[str, str]]:
    """The mapper of the type of settings."""
    s, common, ranges = settings, settings.common(), settings.ranges()
    if isinstance(s, AcesSettings):
        return steps.aces(source, hdr=hdr, key=s.key, **common)
    if isinstance(s, NaturalSettings):
        return steps.natural(source, hdr=hdr, scene=scene, target=s.target_gray, percentile=s.white_point_percentile, out_gray=s.output_mid_gray, compensate=s.auto_brightness_compensation, bypass=s.bypass_tone_compression_for_ldr, threshold=s.ldr_bypass_white_point_threshold, compression=s.tonal_range_compression, ranges=ranges, **common)
    if isinstance(s, ContrastSettings):
        return steps.contrast_balancer(source, forced=hdr, strength=s.strength, compression=s.tone_compression, effect=s.lighting_effect, luminance=s.luminance, white=s.white_clip, black=s.black_clip, ranges=ranges, **common)
    if isinstance(s, BrightnessSettings):
        return steps.brightness_balancer(source, forced=hdr, strength=s.strength, lighting=s.lighting, boost=s.brightness_boost, white=s.white_clip, black=s.black_clip, ranges=ranges, **common)
    raise TypeError(f"no mapper for {type(s).__name__}")


def _carried(chain: list[tuple[str, str]], columns: tuple[str, ...]) -> list[tuple[str, str]]:
    """The steps with further columns of the pixels: every projection of pixels begins with their keys."""
    return [(name, sql.replace(f"SELECT {KEYS},", f"SELECT {KEYS}, {', '.join(columns)},", 1)) for name, sql in chain]


def plan(settings: Settings, source: str = "pixels", hdr: bool = False, scene: float | str = 0.24) -> list[tuple[str, str]]:
    """White balance, mapper, tone boost, dehaze, local contrast, colour temperature, Lab stage, saturation ranges, blend.

    The mapper runs for radiance maps, or where its own controls or gamma aren't neutral; otherwise the common controls go to
    the Lab stage and saturation ranges, which mappers apply themselves, are a stage of their own, evaluated on the source.
    Stages without effect leave no step.  The blend takes the source of a single image, but the mapped radiance map.
    ``scene``: average brightness of the frames of a radiance map, or the column of the source that has it.
    """
    s, ranges = settings, settings.ranges()
    mapped = hdr or not s.core_neutral() or abs(s.gamma - 1) > 1e-5
    weight = max(0.0, min(100.0, s.transparent)) / 100
    carry = (bool(ranges) and not mapped) or (weight > 1e-6)
    out: list[tuple[str, str]] = []
    at, kept = source, ()

    def add(chain: list[tuple[str, str]]) -> None:
        nonlocal at
        out.extend(_carried(chain, kept) if kept else chain)
        at = out[-1][0]

    def keep(name: str) -> None:
        nonlocal at, kept
        kept = SOURCE
        out.append((name, f"SELECT {KEYS}, r, g, b, {', '.join(f'{c} AS {k}' for c, k in zip(RGB, SOURCE, strict=True))} FROM {at}"))
        at = name

    if carry and not hdr:
        keep("tm_source")
    if s.white_balance_reference_type != "None":
        color = s.white_balance_reference_color
        kept = (*kept, scene) if hdr and isinstance(scene, str) else kept
        reference = s.white_balance_reference_type.lower()
        add(steps.white_balance(at) if reference == "auto" else steps.white_balance(at, reference, (color.red, color.green, color.blue)))
    kept = tuple(c for c in kept if c != scene)
    if mapped:
        add(core(s, at, hdr, scene))
    if carry and hdr:
        keep("tm_source")
    if any(abs(b - 1) > 1e-6 for b in s.boosts()):
        add(steps.tone_boost(at, *s.boosts()))
    if s.dehaze > 0:
        add(steps.dehaze(at, s.dehaze))
    if abs(s.local_contrast) > 1e-6:
        add(steps.local_contrast(at, s.local_contrast, max(0, min(100, s.local_contrast_radius))))
    if steps.px.warmth(s.color_temperature):
        add(steps.temperature(at, s.color_temperature))
    lab = s.post_process if mapped else s.common_as_lab().combine(s.post_process)
    if s.auto_adjust_enabled or not lab.is_neutral(1e-6):
        add(steps.lab_post(at, **{k: getattr(lab, k) for k in Lab.__dataclass_fields__}, auto=s.auto_adjust_enabled))
    if ranges and not mapped:
        add(steps.saturation_ranges(at, ranges, SOURCE))
    if weight > 1e-6:
        add([steps.mapped("tm_blend", at, lambda c, i: f"{c} * {n(1 - weight)} + {SOURCE[i]} * {n(weight)}")])
    return out


def tone_map(df: DataFrame, settings: Settings, hdr: bool = False, scene: float = 0.24) -> DataFrame:
    """image_id, y, x, r, g, b mapped by the settings; neutral settings return the input unless it is a radiance map."""
    if settings.is_neutral() and not hdr:
        return df
    chain = plan(settings, hdr=hdr, scene=scene)
    return steps.apply(df, [*chain, ("result", f"SELECT {KEYS}, r, g, b FROM {chain[-1][0] if chain else 'pixels'}")])


def quantized(source: str) -> str:
    """Bytes of a unit image, halves to even."""
    return f"SELECT {KEYS}, " + ", ".join(f"cast({clamp(f'ROUND_EVEN({rounded(f"{c} * 255.0e0", 6)}, 0)', 0.0, 255.0)} AS int) AS {c}" for c in RGB) + f" FROM {source}"


def with_presets(settings: Settings, presets) -> Settings:
    """The settings with the filters of a preset folder behind their own."""
    return replace(settings, saturation_filters=(*settings.saturation_filters, *presets))
