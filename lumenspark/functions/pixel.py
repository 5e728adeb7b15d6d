"""Per-pixel maps as expression text over channel expressions; all inline into one projection."""

from __future__ import annotations

from .dialect import clamp, n

# Luminance weights, curve fit and matrices of the filmic mapping, colour conversion.
LUMA = (0.2126, 0.7152, 0.0722)
ACES_FIT = (0.0245786, 0.000090537, 0.983729, 0.4329510, 0.238081)
ACES_IN = ((0.59719, 0.35458, 0.04823), (0.07600, 0.90834, 0.01566), (0.02840, 0.13383, 0.83777))
ACES_OUT = ((1.60475, -0.53108, -0.07367), (-0.10208, 1.10813, -0.00605), (-0.00327, -0.07276, 1.07602))
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
LAB_PIVOT, LAB_FACTOR = 0.008856, 7.787
EPS = 1e-6

RGB = ("r", "g", "b")


def dot(weights, values) -> str:
    return "(" + " + ".join(f"{n(w)} * ({v})" for w, v in zip(weights, values, strict=True)) + ")"


def luma(r="r", g="g", b="b") -> str:
    return dot(LUMA, (r, g, b))


def gray_byte(r="r", g="g", b="b") -> str:
    return f"((54 * {r} + 183 * {g} + 19 * {b}) DIV 256)"


def hat_weight(z: str) -> str:
    return f"exp(-(({z} - 128) / 96.0e0) * (({z} - 128) / 96.0e0))"


def midtone_weight(z: str, power: float = 2.0) -> str:
    return f"greatest(0.0e0, 1.0e0 - pow(abs({z} - 0.5e0) * 2.0e0, {n(power)}))"


def motion_weight(diff: str, alpha: float) -> str:
    return f"exp(-2.0e0 * {n(alpha)} * ({diff}))"


def aces_curve(x: str) -> str:
    a, b, c, d, e = map(n, ACES_FIT)
    x = f"greatest({x}, 0.0e0)"
    return f"greatest(0.0e0, ({x} * ({x} + {a}) - {b}) / ({x} * ({c} * {x} + {d}) + {e}))"


def contrast(v: str, c: float) -> str:
    return v if abs(c - 1) < 1e-6 else clamp(f"(({v}) - 0.5e0) * {n(c)} + 0.5e0")


def smoothstep(low: float, high: float, x: str) -> str:
    t = clamp(f"(({x}) - {n(low)}) / {n(high - low)}")
    return f"({t} * {t} * (3.0e0 - 2.0e0 * {t}))"


def lerp(a: str, b: str, t: str) -> str:
    return f"(({a}) + (({b}) - ({a})) * ({t}))"


def gamma(v: str, g: float) -> str:
    return v if abs(g - 1) <= 1e-3 else clamp(f"pow({v}, {n(1 / max(g, 0.1))})")


def saturation_multiplier(slider: float) -> float:
    s = max(-100.0, min(100.0, slider))
    return 1 + s / 100 if s <= 0 else 1 + s / 50


def saturate(v: str, lum: str, s: str) -> str:
    return f"({lum} + (({v}) - {lum}) * ({s}))"


def peak(r="r", g="g", b="b") -> str:
    return f"greatest({r}, {g}, {b})"


def floor_of(r="r", g="g", b="b") -> str:
    return f"least({r}, {g}, {b})"


def hsv(r="r", g="g", b="b") -> tuple[str, str, str]:
    hi, lo = peak(r, g, b), floor_of(r, g, b)
    d = f"({hi} - {lo})"
    raw = f"(60.0e0 * CASE WHEN {hi} = {r} THEN (({g} - {b}) / {d}) % 6.0e0 WHEN {hi} = {g} THEN ({b} - {r}) / {d} + 2.0e0 ELSE ({r} - {g}) / {d} + 4.0e0 END)"
    h = f"CASE WHEN {d} <= {n(EPS)} THEN 0.0e0 WHEN {raw} < 0.0e0 THEN {raw} + 360.0e0 ELSE {raw} END"
    s = f"CASE WHEN {hi} <= {n(EPS)} THEN 0.0e0 ELSE {d} / {hi} END"
    return h, s, hi


def vibrance(s: str, sat: str) -> str:
    """Saturation factor ``s`` less for pixels that are saturated already."""
    return f"CASE WHEN {s} <= 1.0e0 THEN {s} ELSE 1.0e0 + ({s} - 1.0e0) * {clamp(f'1.0e0 - ({sat})')} END"


def linear_strength(v: str, low: float, high: float) -> str:
    low, high = sorted((max(0.0, min(1.0, low)), max(0.0, min(1.0, high))))
    if low <= 1e-6 and high >= 1 - 1e-6:
        return "1.0e0"
    if high - low <= 1e-6:
        return f"CASE WHEN abs({v} - {n(low)}) <= {n(EPS)} THEN 1.0e0 ELSE 0.0e0 END"
    edge = f"least({v} - {n(low)}, {n(high)} - {v})"
    return f"CASE WHEN {v} < {n(low)} OR {v} > {n(high)} THEN 0.0e0 ELSE {clamp(f'2.0e0 * {edge} / {n(high - low)}')} END"


def hue_strength(h: str, low: float, high: float) -> str:
    if abs(high - low) >= 360:
        return "1.0e0"
    low, high = low % 360, high % 360
    width = (high - low) % 360
    if width <= 1e-6:
        return f"CASE WHEN abs({h} - {n(low)}) <= {n(EPS)} THEN 1.0e0 ELSE 0.0e0 END"
    at = f"(({h} - {n(low)} + 360.0e0) % 360.0e0)"
    return f"CASE WHEN {at} > {n(width)} THEN 0.0e0 ELSE {clamp(f'2.0e0 * least({at}, {n(width)} - {at}) / {n(width)}')} END"


def range_factor(h: str, s: str, v: str, ranges) -> str:
    """1 plus the sum of adjustments by strength, at least 0.  ranges: (hue, hue, sat, sat, value, value, adjustment)."""
    parts = [f"{n(a / 100 if a <= 0 else a / 50)} * least({hue_strength(h, h0, h1)}, {linear_strength(s, s0, s1)}, {linear_strength(v, v0, v1)})" for h0, h1, s0, s1, v0, v1, a in ranges]
    return f"greatest(0.0e0, 1.0e0 + {' + '.join(parts)})" if parts else "1.0e0"


def tone_boost(lum: str, shadows: float, midtones: float, highlights: float) -> str:
    """Factor of all channels."""
    sh, hi = clamp(f"(0.5e0 - {lum}) / 0.5e0"), clamp(f"({lum} - 0.5e0) / 0.5e0")
    mid = clamp(f"1.0e0 - 2.0e0 * abs({lum} - 0.5e0)")
    boost = f"({sh} * {n(shadows)} + {mid} * {n(midtones)} + {hi} * {n(highlights)})"
    return f"({clamp(f'{lum} * {boost}')} / greatest({lum}, {n(EPS)}))"


def dehaze(v: str, dark: str, amount: float) -> str:
    s = max(0.0, min(1.0, amount / 100))
    veil = f"(0.95e0 * {dark} * {n(s)})"
    clear = clamp(f"({v} - {veil}) / {clamp(f'1.0e0 - {veil}', 0.35, 1.0)}")
    return v if s <= 0 else clamp(lerp(v, clear, f"{n(s)} * {smoothstep(0.02, 0.35, dark)}"))


def warmth(kelvin: float) -> float:
    if abs(kelvin) < 1e-6 or abs(kelvin - 6500) < 1e-6:
        return 0.0
    k = max(2000.0, min(12000.0, kelvin))
    return (6500 - k) / 4500 if k <= 6500 else -(k - 6500) / 5500


def temperature(kelvin: float) -> tuple[float, float, float]:
    w = warmth(kelvin)
    return 1 + 0.2 * w, 1 + 0.05 * abs(w), 1 - 0.2 * w


def to_linear(c: str) -> str:
    return f"CASE WHEN {c} <= 0.04045e0 THEN {c} / 12.92e0 ELSE pow(({c} + 0.055e0) / 1.055e0, 2.4e0) END"


def to_srgb(c: str) -> str:
    return f"CASE WHEN {c} <= 0.0031308e0 THEN 12.92e0 * {c} ELSE 1.055e0 * pow({c}, {n(1 / 2.4)}) - 0.055e0 END"


def lab_curve(t: str) -> str:
    return f"CASE WHEN {t} > {n(LAB_PIVOT)} THEN pow({t}, {n(1 / 3)}) ELSE {n(LAB_FACTOR)} * {t} + {n(16 / 116)} END"


def lab_inverse(t: str) -> str:
    return f"CASE WHEN {t} * {t} * {t} > {n(LAB_PIVOT)} THEN {t} * {t} * {t} ELSE ({t} - {n(16 / 116)}) / {n(LAB_FACTOR)} END"
