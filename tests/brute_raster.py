"""Arrays of an image (h, w, 3) mapped by settings, written from the definitions and apart from the operators' SQL."""

import numpy as np

LUMA = np.array([0.2126, 0.7152, 0.0722])


def clip(v, lo=0.0, hi=1.0):
    return np.minimum(np.maximum(v, lo), hi)


def light(p):
    return p @ LUMA


def slider(s):
    s = min(100.0, max(-100.0, s))
    return 1 + s / (100 if s <= 0 else 50)


def smooth(lo, hi, x):
    t = clip((x - lo) / (hi - lo))
    return t * t * (3 - 2 * t)


def hsv(p):
    out = np.zeros(p.shape)
    for at in np.ndindex(p.shape[:-1]):
        r, g, b = p[at]
        hi, lo = max(p[at]), min(p[at])
        d = hi - lo
        h = 0.0
        if d > 1e-6:
            h = 60 * (np.fmod((g - b) / d, 6) if hi == r else (b - r) / d + 2 if hi == g else (r - g) / d + 4)
            h += 360 if h < 0 else 0
        out[at] = h, d / hi if hi > 1e-6 else 0.0, hi
    return out


def triangle(v, lo, hi):
    lo, hi = sorted((min(1, max(0, lo)), min(1, max(0, hi))))
    if lo <= 1e-6 and hi >= 1 - 1e-6:
        return 1.0
    if hi - lo <= 1e-6:
        return float(abs(v - lo) <= 1e-6)
    return 0.0 if v < lo or v > hi else min(1.0, max(0.0, 2 * min(v - lo, hi - v) / (hi - lo)))


def around(h, lo, hi):
    if abs(hi - lo) >= 360:
        return 1.0
    lo, hi = lo % 360, hi % 360
    width = (hi - lo) % 360
    if width <= 1e-6:
        return float(abs(h - lo) <= 1e-6)
    at = (h - lo) % 360
    return 0.0 if at > width else min(1.0, max(0.0, 2 * min(at, width - at) / width))


def factor(p, ranges):
    out = np.ones(p.shape[:-1])
    for at, (h, s, v) in zip(np.ndindex(p.shape[:-1]), hsv(p).reshape(-1, 3), strict=True):
        total = sum((a / 100 if a <= 0 else a / 50) * min(around(h, h0, h1), triangle(s, s0, s1), triangle(v, v0, v1)) for h0, h1, s0, s1, v0, v1, a in ranges)
        out[at] = max(0.0, 1 + total)
    return out


def contrast(v, c):
    return v if abs(c - 1) < 1e-6 else clip((v - 0.5) * c + 0.5)


def gamma(v, g):
    return v if abs(g - 1) <= 1e-3 else clip(v ** (1 / max(g, 0.1)))


def saturate(p, k):
    lum = light(p)[..., None]
    return lum + (p - lum) * (k[..., None] if isinstance(k, np.ndarray) else k)


def natural(p, s):
    """Only where the compression is bypassed."""
    lum = light(p)
    k = 2.0**s.exposure_ev
    if s.auto_brightness_compensation:
        k *= min(4.0, max(0.1, s.output_mid_gray / max(np.exp(np.mean(np.log(np.maximum(lum, 1e-6)))) * k, 1e-6)))
    m = clip(clip(contrast(np.maximum(lum * k, 1e-6), s.contrast)) * s.brightness)
    q = p * (m / np.maximum(lum, 1e-6))[..., None]
    sat = max(0.0, slider(s.saturation))
    vivid = np.full(lum.shape, sat) if sat <= 1 else 1 + (sat - 1) * clip(1 - hsv(q)[..., 1])
    k = (vivid * factor(p, s.ranges()))[..., None]
    return gamma(clip(m[..., None] + (q - m[..., None]) * k), s.gamma)


def aces(p, s):
    into = np.array([[0.59719, 0.35458, 0.04823], [0.07600, 0.90834, 0.01566], [0.02840, 0.13383, 0.83777]])
    out = np.array([[1.60475, -0.53108, -0.07367], [-0.10208, 1.10813, -0.00605], [-0.00327, -0.07276, 1.07602]])

    def curve(x):
        x = np.maximum(x, 0)
        return np.maximum(0, (x * (x + 0.0245786) - 0.000090537) / (x * (0.983729 * x + 0.4329510) + 0.238081))

    neutral = 0.18 / (np.exp(np.mean(np.log(1e-4 + light(p)))) + 1e-9) * 2.0**s.exposure_ev
    mapped = lambda e: curve(p * e @ into.T) @ out.T
    q = contrast((p + mapped(neutral * s.key / 0.18) - mapped(neutral)) * s.brightness, s.contrast)
    return gamma(clip(saturate(q, slider(s.saturation)) if abs(slider(s.saturation) - 1) > 1e-6 else q), s.gamma)


def balanced(p, s):
    """The contrast balancer."""
    lum = np.maximum(light(p), 1e-6)
    a = np.exp(np.mean(np.log(lum)))
    x = lum * s.luminance * 2.0**s.exposure_ev
    lit = a + (x / (x + s.tone_compression) - a) * s.lighting_effect
    d = clip(clip(((lit - s.black_clip) / (s.white_clip - s.black_clip) - 0.5) * s.contrast + 0.5) * s.brightness)
    m = lum + (d - lum) * s.strength
    k = (slider(s.saturation) * factor(p, s.ranges()))[..., None]
    q = p * (m / lum)[..., None]
    return gamma(clip(m[..., None] + (q - m[..., None]) * k), s.gamma)


def lab(p):
    lin = np.where(p <= 0.04045, p / 12.92, ((p + 0.055) / 1.055) ** 2.4)
    t = lin @ np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]).T / [0.95047, 1.0, 1.08883]
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def unlab(q):
    fy = (q[..., 0] + 16) / 116
    f = np.stack([q[..., 1] / 500 + fy, fy, fy - q[..., 2] / 200], -1)
    t = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * [0.95047, 1.0, 1.08883]
    lin = t @ np.array([[3.2404542, -1.5371385, -0.4985314], [-0.9692660, 1.8760108, 0.0415560], [0.0556434, -0.2040259, 1.0572252]]).T
    return np.where(lin <= 0.0031308, 12.92 * lin, 1.055 * np.maximum(lin, 1e-300) ** (1 / 2.4) - 0.055)


def lab_stage(p, x):
    q = lab(p)
    lo, hi = q[..., 0].min(), q[..., 0].max()
    at = (q[..., 0] - lo) / max(hi - lo, 1e-6)
    v = q[..., 0] * min(1.25, max(0.85, 2.0**x.exposure)) * x.brightness
    v = v + smooth(0, 0.35, 1 - at) * 12 * (x.shadows - 1) + np.exp(-((at - 0.5) ** 2) / 0.12) * 6 * (x.midtones - 1) - smooth(0.55, 1, at) * 12 * (x.highlights - 1)
    c = (v - 50) / 50
    v = v + c * (1 - np.abs(c)) * 40 * (x.contrast - 1)
    k = (1 + (1 - smooth(8, 60, np.hypot(q[..., 1], q[..., 2]))) * (x.vibrance - 1))[..., None]
    return unlab(np.concatenate([clip(v, 0, 100)[..., None], q[..., 1:] * k], -1))


def local(p, amount, radius):
    h, w, _ = p.shape
    means = np.array([[p[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].mean((0, 1)) for x in range(w)] for y in range(h)])
    return clip(p + (p - means) * min(1, max(-1, amount / 100)))


def mapped(p, s, mapper):
    """The stages about a mapper, for a single image."""
    source, core = p, not s.core_neutral() or abs(s.gamma - 1) > 1e-5
    if s.white_balance_reference_type == "Auto":
        means = p.mean((0, 1))
        p = clip(p * clip(means.mean() / np.maximum(means, 1e-6), 0.8, 1.2))
    if core:
        p = mapper(p, s)
    if s.boosts() != (1, 1, 1):
        lum = light(p)
        boost = clip((0.5 - lum) / 0.5) * s.shadows_boost + clip(1 - 2 * abs(lum - 0.5)) * s.midtones_boost + clip((lum - 0.5) / 0.5) * s.highlights_boost
        p = clip(p * (clip(lum * boost) / np.maximum(lum, 1e-6))[..., None])
    if s.dehaze:
        dark, k = p.min(-1)[..., None], s.dehaze / 100
        veil = 0.95 * dark * k
        p = clip(p + (clip((p - veil) / clip(1 - veil, 0.35, 1)) - p) * k * smooth(0.02, 0.35, dark))
    if s.local_contrast:
        p = local(p, s.local_contrast, s.local_contrast_radius)
    if s.color_temperature not in (0, 6500):
        kelvin = min(12000, max(2000, s.color_temperature))
        warm = (6500 - kelvin) / (4500 if kelvin < 6500 else 5500)
        p = clip(p * [1 + 0.2 * warm, 1 + 0.05 * abs(warm), 1 - 0.2 * warm])
    x = s.post_process if core else s.common_as_lab().combine(s.post_process)
    if not x.is_neutral():
        p = lab_stage(p, x)
    if s.ranges() and not core:
        p = clip(saturate(p, factor(source, s.ranges())))
    share = s.transparent / 100
    return p * (1 - share) + source * share
