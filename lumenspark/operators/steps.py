"""Operators as chains of named SELECTs over a table of pixels (image_id, y, x, r, g, b).

``apply(df, steps)`` runs a chain on any DataFrame of these columns; the same steps, rendered for DuckDB, are the oracle.
Statistics of an image are grouped aggregates joined back on image_id: pixels are never gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..functions import pixel as px
from ..functions.dialect import chain, clamp, n, spark_text

KEYS, RGB = "image_id, y, x", px.RGB


def apply(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Steps read ``pixels`` first."""
    return df.sparkSession.sql(spark_text(chain([("pixels", "SELECT * FROM {src}"), *steps])), src=df)


def _rgb(f, keys=KEYS, more="") -> str:
    return f"{keys}{more}, " + ", ".join(f"{f(c, i)} AS {c}" for i, c in enumerate(px.RGB))


def mapped(name: str, source: str, f, keys=KEYS, more="") -> tuple[str, str]:
    """One projection; ``f(channel, place)`` gives the new channel."""
    return name, f"SELECT {_rgb(f, keys, more)} FROM {source}"


def stats(source: str, aggregates: str, name: str) -> tuple[str, str]:
    return name, f"SELECT image_id, {aggregates} FROM {source} GROUP BY image_id"


#: A threshold that no image passes.
LIMITLESS = 3.0e38
#: Bins to a unit in the search of percentiles.
BINS = 1024


def quantiles(source: str, value: str, shares: dict[str, float], name: str) -> list[tuple[str, str]]:
    """``name``: image_id and, by names, the values at shares of the sorted values of each image, between neighbours in proportion.

    A histogram tells in which bins the wanted ranks lie; only the distinct values of these bins, with their numbers, are sorted.
    """
    asked = " UNION ALL ".join(f"SELECT '{k}' AS k, {n(p)} AS p, {step} AS step" for k, p in shares.items() for step in (0, 1))
    picked = lambda k, step: f"max(CASE WHEN k = '{k}' AND step = {step} THEN v END)"
    part = lambda k, p: f"({n(p)} * (max(n) - 1) - floor({n(p)} * (max(n) - 1)))"
    return [
        (f"{name}_bin", f"SELECT image_id, v, cast(floor(v * {n(BINS)}) AS bigint) AS bin FROM (SELECT image_id, {value} AS v FROM {source}) q"),
        (f"{name}_hist", f"SELECT image_id, bin, count(*) AS c FROM {name}_bin GROUP BY image_id, bin"),
        (f"{name}_cum", f"SELECT image_id, bin, c, sum(c) OVER (PARTITION BY image_id ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY image_id) AS n FROM {name}_hist"),
        (f"{name}_asked", asked),
        (f"{name}_rank", f"SELECT image_id, bin, upto - c AS before, upto, n, k, step, least(n - 1, cast(floor(p * (n - 1)) AS bigint) + step) AS place FROM {name}_cum CROSS JOIN {name}_asked"),
        (f"{name}_held", f"SELECT * FROM {name}_rank WHERE place >= before AND place < upto"),
        (f"{name}_some", f"SELECT DISTINCT image_id, bin FROM {name}_held"),
        (f"{name}_vals", f"SELECT b.image_id, b.bin, v, count(*) AS c FROM {name}_bin b JOIN {name}_some s ON b.image_id = s.image_id AND b.bin = s.bin GROUP BY b.image_id, b.bin, v"),
        (f"{name}_sort", f"SELECT image_id, bin, v, c, sum(c) OVER (PARTITION BY image_id, bin ORDER BY v) AS upto FROM {name}_vals"),
        (f"{name}_hit", f"SELECT h.image_id, k, step, n, v FROM {name}_held h JOIN {name}_sort s ON h.image_id = s.image_id AND h.bin = s.bin WHERE h.place - h.before < s.upto AND h.place - h.before >= s.upto - s.c"),
        (name, f"SELECT image_id, {', '.join(f'{picked(k, 0)} + ({picked(k, 1)} - {picked(k, 0)}) * {part(k, p)} AS {k}' for k, p in shares.items())} FROM {name}_hit GROUP BY image_id"),
    ]


LOG_AVERAGE = f"exp(avg(ln(greatest({px.luma()}, {n(px.EPS)}))))"


def natural(source="pixels", hdr=False, scene=0.24, target=0.24, percentile=1.0, out_gray=0.25, compensate=False, compression=4.0, ev=0.0, brightness=1.0, contrast=1.0, saturation=0.0, gamma=1.0, bypass=True, threshold=None, ranges=()):
    """Natural tone mapping: compression about the log average, or the LDR bypass where nothing forces compression.

    ``scene``: average brightness of the frames of a radiance map, or the column of the source that has it.  ``threshold``: images whose white
    level or greatest luminance is above it are not bypassed.
    """
    e, sat = 2.0**ev, max(0.0, px.saturation_multiplier(saturation))
    eps, lum = n(px.EPS), f"greatest(lum, {n(px.EPS)})"
    bypass, by_image = bypass and not hdr, bypass and not hdr and threshold is not None and threshold < LIMITLESS
    seen = f", {scene} AS scene_light" if hdr and isinstance(scene, str) else ""
    steps = [("nt_lum", f"SELECT {KEYS}, r, g, b, {px.luma()} AS lum{seen} FROM {source}")]
    steps.append(stats("nt_lum", f"exp(avg(ln({lum}))) AS a, max(lum) AS top{', max(scene_light) AS scene_light' if seen else ''}", "nt_sums"))
    if percentile >= 1:
        steps.append(("nt_stats", "SELECT *, top AS w FROM nt_sums"))
    else:
        steps += [*quantiles("nt_lum", "lum", {"w": max(0.0, percentile)}, "nt_white"), ("nt_stats", "SELECT s.*, w FROM nt_sums s JOIN nt_white q ON s.image_id = q.image_id")]
    # the bypass: luminance by the exposure, compensated by the average
    k = f"{n(e)}" + (f" * {clamp(f'{n(out_gray)} / greatest(a * {n(e)}, {eps})', 0.1, 4.0)}" if compensate else "")
    plain = f"greatest(lum * {k}, {eps})"
    plain = clamp(clamp(px.contrast(plain, max(contrast, 0.0)) if abs(contrast - 1) >= 1e-6 else plain) + f" * {n(max(brightness, 0.0))}")
    # the compression
    t = clamp(f"scene_light * {n(target / 0.24)}", 0.01, 0.99) if seen else n(max(0.01, min(0.99, scene * (target / 0.24))) if hdr else max(target, 0.01))
    wp = f"greatest(w * {t} / greatest(a, {eps}), 1.0e-3)"
    mean = f"greatest(a * k0, {eps})"
    comp = clamp(f"{n(out_gray)} / greatest({mean} * (1.0e0 + {mean} / w2) / (1.0e0 + {mean}), {eps})", 0.1, 4.0) if compensate else "1.0e0"
    ac = f"(1.0e0 + {n(contrast - 1)} * (0.35e0 + 0.65e0 * dr))"
    s0 = n(sat) if sat <= 1 else f"(1.0e0 + {n(sat - 1)} * (0.4e0 + 0.6e0 * dr) * (1.0e0 - {clamp(f'(ex - ex / (1.0e0 + ex)) / (ex + {eps})')}))"
    m = clamp(clamp(f"(ex * (1.0e0 + ex / w2) / (1.0e0 + ex) * bc - 0.5e0) * {ac} + 0.5e0") + f" * {n(brightness)}")
    if bypass and not by_image:
        steps += [("nt_exposed", f"SELECT p.*, {plain} AS m, {n(sat)} AS s0 FROM nt_lum p JOIN nt_stats USING (image_id)"), ("nt_scaled", f"SELECT {KEYS}, r, g, b, m, m / {lum} AS k, s0 FROM nt_exposed")]
    else:
        low = f"CASE WHEN w <= {n(threshold)} AND top <= {n(threshold)} THEN 1 ELSE 0 END" if by_image else "0"
        either = lambda x, y: f"CASE WHEN low = 1 THEN {x} ELSE {y} END" if by_image else y
        steps += [
            ("nt_image", f"SELECT image_id, a, {low} AS low, {t} / greatest(a, {eps}) AS k0, {wp} * {wp} * {n(max(compression, 1e-3))} AS w2, top / (top + a + {eps}) AS dr FROM nt_stats"),
            ("nt_exposed", f"SELECT p.*, {lum} AS l1, {lum} * k0 * {n(e)} AS ex, a, low, w2, dr, {comp} AS bc FROM nt_lum p JOIN nt_image USING (image_id)"),
            ("nt_both", f"SELECT *, {either(plain, m)} AS m, {either(n(sat), s0)} AS s0 FROM nt_exposed"),
            ("nt_scaled", f"SELECT {KEYS}, r, g, b, m, m / l1 AS k, s0 FROM nt_both"),
        ]
    h, s, v = px.hsv()
    hs = "CASE WHEN greatest(r * k, g * k, b * k) <= 1.0e-6 THEN 0.0e0 ELSE (greatest(r * k, g * k, b * k) - least(r * k, g * k, b * k)) / greatest(r * k, g * k, b * k) END"
    factor = px.range_factor(h, s, v, ranges)
    steps.append(("nt_sat", f"SELECT *, ({px.vibrance('s0', hs)}) * {factor} AS s1 FROM nt_scaled"))
    steps.append(mapped("nt_out", "nt_sat", lambda c, i: px.gamma(clamp(px.saturate(f"{c} * k", "m", "s1")), gamma)))
    return steps


def aces(source="pixels", hdr=False, key=0.18, ev=0.0, brightness=1.0, contrast=1.0, saturation=0.0, gamma=1.0):
    """Filmic tone mapping; single images get the difference to the neutral mapping added."""
    sat = px.saturation_multiplier(saturation)
    names = ("0", "1", "2")
    steps = [
        stats(source, f"0.18e0 / (exp(avg(ln(1.0e-4 + {px.luma()}))) + 1.0e-9) * {n(2.0**ev)} AS neutral", "ac_stats"),
        ("ac_in", f"SELECT p.*, neutral, neutral * {n(key / 0.18)} AS exposure FROM {source} p JOIN ac_stats USING (image_id)"),
        ("ac_curve", f"SELECT {KEYS}, r, g, b, " + ", ".join(f"{px.aces_curve(px.dot(px.ACES_IN[i], [f'{c} * {e}' for c in px.RGB]))} AS {a}{i}" for a, e in (("m", "exposure"), ("n", "neutral")) for i in range(3)) + " FROM ac_in"),
        ("ac_mix", f"SELECT {KEYS}, " + ", ".join((px.dot(px.ACES_OUT[i], [f"m{j}" for j in names]) if hdr else f"{c} + {px.dot(px.ACES_OUT[i], [f'm{j}' for j in names])} - {px.dot(px.ACES_OUT[i], [f'n{j}' for j in names])}") + f" AS {c}" for i, c in enumerate(px.RGB)) + " FROM ac_curve"),
        mapped("ac_light", "ac_mix", lambda c, i: px.contrast(f"({c} * {n(brightness)})", contrast)),
    ]
    f = (lambda c, i: px.gamma(clamp(c), gamma)) if abs(sat - 1) <= 1e-6 else (lambda c, i: px.gamma(clamp(px.saturate(c, px.luma(), n(sat))), gamma))
    return [*steps, mapped("ac_out", "ac_light", f)]


def _balanced(source, adapted, brightness_of, strength, saturation, gamma, ranges=()):
    sat = max(0.0, px.saturation_multiplier(saturation))
    h, s, v = px.hsv()
    return [
        stats(source, f"{LOG_AVERAGE} AS a", "ba_stats"),
        ("ba_lum", f"SELECT p.*, greatest({px.luma()}, {n(px.EPS)}) AS l, a FROM {source} p JOIN ba_stats USING (image_id)"),
        ("ba_adapted", f"SELECT {KEYS}, r, g, b, l, {adapted} AS d FROM ba_lum"),
        ("ba_hsv", f"SELECT *, {h} AS hue, {s} AS sat, {v} AS val FROM ba_adapted"),
        ("ba_mapped", f"SELECT {KEYS}, r, g, b, l, l + ({brightness_of} - l) * {n(strength)} AS m, {n(sat)} * {px.range_factor('hue', 'sat', 'val', ranges)} AS s FROM ba_hsv"),
        mapped("ba_out", "ba_mapped", lambda c, i: px.gamma(clamp(px.saturate(f"{c} * (m / l)", "m", "s")), gamma)),
    ]


def contrast_balancer(source="pixels", forced=False, strength=1.0, compression=1.0, effect=1.0, luminance=1.0, white=1.0, black=0.0, ev=0.0, brightness=1.0, contrast=1.0, saturation=0.0, gamma=1.0, ranges=()):
    active = forced or any(abs(v) > 1e-6 for v in (compression - 1, effect - 1, luminance - 1, white - 1, black, ev, brightness - 1, contrast - 1))
    black = max(0.0, min(0.99, black))
    white = max(black + 1e-3, min(4.0, white))
    k = max(0.0, luminance) * 2.0**ev
    lit = f"(a + (l * {n(k)} / (l * {n(k)} + {n(max(compression, 1e-3))}) - a) * {n(max(0.0, effect))})"
    adapted = clamp(f"(({lit} - {n(black)}) * {n(1 / (white - black))} - 0.5e0) * {n(max(0.0, contrast))} + 0.5e0")
    return _balanced(source, adapted, clamp(f"d * {n(max(0.0, brightness))}"), max(0.0, min(1.0, strength)) if active else 0.0, saturation, gamma, ranges)


def brightness_balancer(source="pixels", forced=False, strength=1.0, lighting=1.0, boost=1.0, white=1.0, black=0.0, ev=0.0, brightness=1.0, contrast=1.0, saturation=0.0, gamma=1.0, ranges=()):
    active = forced or any(abs(v) > 1e-6 for v in (lighting - 1, white - 1, black))
    black = max(0.0, min(0.99, black))
    white = max(black + 1e-3, min(4.0, white))
    k = 2.0**ev
    lit = f"(a + (l * {n(k)} / (1.0e0 + l * {n(k)}) - a) * {n(max(0.0, lighting))})"
    adapted = clamp(f"({clamp(f'({lit} - {n(black)}) * {n(1 / (white - black))}')} - 0.5e0) * {n(max(0.0, contrast))} + 0.5e0")
    return _balanced(source, adapted, clamp(f"{'d' if active else 'l'} * {n(max(0.0, boost) * max(brightness, 0.0))}"), max(0.0, min(1.0, strength)), saturation, gamma, ranges)


def tone_boost(source, shadows, midtones, highlights):
    return [("tb_k", f"SELECT *, {px.tone_boost(px.luma(), shadows, midtones, highlights)} AS k FROM {source}"), mapped("tb_out", "tb_k", lambda c, i: clamp(f"{c} * k"))]


def dehaze(source, amount):
    return [("dh_dark", f"SELECT *, {px.floor_of()} AS dark FROM {source}"), mapped("dh_out", "dh_dark", lambda c, i: px.dehaze(c, "dark", amount))]


def temperature(source, kelvin):
    k = px.temperature(kelvin)
    return [mapped("ct_out", source, lambda c, i: clamp(f"{c} * {n(k[i])}"))]


def saturation_ranges(source, ranges, of=px.RGB):
    """Saturation by boxes of hue, saturation and value that are looked up in the channels ``of``."""
    h, s, v = px.hsv(*of)
    return [
        ("sr_hsv", f"SELECT *, {h} AS hue, {s} AS sat, {v} AS val, {px.luma()} AS lum FROM {source}"),
        ("sr_k", f"SELECT *, {px.range_factor('hue', 'sat', 'val', ranges)} AS k FROM sr_hsv"),
        mapped("sr_out", "sr_k", lambda c, i: clamp(px.saturate(c, "lum", "k"))),
    ]


def white_balance(source="pixels", reference=None, colour=(0.0, 0.0, 0.0)):
    """Gray world, or a reference colour that is to be black, gray or white."""
    if reference:
        level = {"black": 0.02, "gray": 0.5, "white": 0.98}[reference]
        k = [max(0.1, min(10.0, level / max(c, 1e-6))) for c in colour]
        return [mapped("wb_out", source, lambda c, i: clamp(f"{c} * {n(k[i])}"))]
    return [stats(source, "avg(r) AS ar, avg(g) AS ag, avg(b) AS ab", "wb_stats"), ("wb_in", f"SELECT p.*, ar, ag, ab FROM {source} p JOIN wb_stats USING (image_id)"), mapped("wb_out", "wb_in", lambda c, i: clamp(f"{c} * {clamp(f'(ar + ag + ab) / 3.0e0 / greatest(a{c}, 1.0e-6)', 0.8, 1.2)}"))]


def to_lab(source="pixels", name="lab"):
    return [
        (f"{name}_xyz", f"SELECT {KEYS}, " + ", ".join(f"{px.dot(px.TO_XYZ[i], [px.to_linear(c) for c in px.RGB])} / {n(px.WHITE[i])} AS t{i}" for i in range(3)) + f" FROM {source}"),
        (f"{name}_f", f"SELECT {KEYS}, " + ", ".join(f"{px.lab_curve(f't{i}')} AS f{i}" for i in range(3)) + f" FROM {name}_xyz"),
        (name, f"SELECT {KEYS}, 116.0e0 * f1 - 16.0e0 AS l, 500.0e0 * (f0 - f1) AS a, 200.0e0 * (f1 - f2) AS bb FROM {name}_f"),
    ]


def from_lab(source="lab", name="rgb_out"):
    return [
        (f"{name}_f", f"SELECT {KEYS}, a / 500.0e0 + (l + 16.0e0) / 116.0e0 AS f0, (l + 16.0e0) / 116.0e0 AS f1, (l + 16.0e0) / 116.0e0 - bb / 200.0e0 AS f2 FROM {source}"),
        (f"{name}_t", f"SELECT {KEYS}, " + ", ".join(f"({px.lab_inverse(f'f{i}')}) * {n(px.WHITE[i])} AS t{i}" for i in range(3)) + f" FROM {name}_f"),
        (f"{name}_lin", f"SELECT {KEYS}, " + ", ".join(f"{px.dot(px.FROM_XYZ[i], ['t0', 't1', 't2'])} AS {c}" for i, c in enumerate(px.RGB)) + f" FROM {name}_t"),
        mapped(name, f"{name}_lin", lambda c, i: px.to_srgb(c)),
    ]


#: Columns of automatic adjustments, and what of them is applied: nothing that darkens, no highlights.
AUTO = {"exposure": "greatest(0.0e0, au_ev)", **{k: f"greatest(1.0e0, au_{v})" for k, v in (("brightness", "brightness"), ("shadows", "shadows"), ("midtones", "midtones"), ("contrast", "contrast"), ("vibrance", "saturation"))}}


def lab_post(source="pixels", exposure=0.0, brightness=1.0, shadows=1.0, midtones=1.0, highlights=1.0, contrast=1.0, vibrance=1.0, auto=False):
    """Adjustments in Lab by masks over the image's lightness range; with ``auto``, those of the analysed image come on top."""

    def given(name, value):
        return n(value) if not auto or name not in AUTO else f"({n(value)} + {AUTO[name]})" if name == "exposure" else f"({n(value)} * {AUTO[name]})"

    au = ", au_ev, au_contrast, au_brightness, au_shadows, au_midtones, au_saturation" if auto else ""
    e = f"(greatest(0.85e0, least(1.25e0, pow(2.0e0, {given('exposure', exposure)}))) * {given('brightness', brightness)})" if auto else n(max(0.85, min(1.25, 2.0**exposure)) * brightness)
    lift = lambda k, name, value: f"({n(k)} * ({given(name, value)} - 1.0e0))"
    masks = f"l * {e} + {px.smoothstep(0.0, 0.35, '1.0e0 - ln_')} * {lift(12, 'shadows', shadows)} + exp(-((ln_ - 0.5e0) * (ln_ - 0.5e0)) / 0.12e0) * {lift(6, 'midtones', midtones)} - {px.smoothstep(0.55, 1.0, 'ln_')} * {lift(12, 'highlights', highlights)}"
    curve = "l1" if abs(contrast - 1) <= 1e-6 and not auto else f"l1 + (l1 - 50.0e0) / 50.0e0 * (1.0e0 - abs((l1 - 50.0e0) / 50.0e0)) * {lift(40, 'contrast', contrast)}"
    k = f"(1.0e0 + (1.0e0 - {px.smoothstep(8, 60, 'sqrt(a * a + bb * bb)')}) * ({given('vibrance', vibrance)} - 1.0e0))"
    analysed = [*analyzer(source), ("au", "SELECT image_id, ev AS au_ev, contrast AS au_contrast, brightness AS au_brightness, shadows AS au_shadows, midtones AS au_midtones, saturation AS au_saturation FROM an_out")] if auto else []
    return [
        *analysed,
        *to_lab(source, "lp"),
        stats("lp", "min(l) AS lo, max(l) AS hi", "lp_stats"),
        ("lp_norm", f"SELECT p.*, (l - lo) / greatest(hi - lo, 1.0e-6) AS ln_{au} FROM lp p JOIN lp_stats USING (image_id){' JOIN au USING (image_id)' if auto else ''}"),
        ("lp_masks", f"SELECT {KEYS}, {masks} AS l1, a, bb{au} FROM lp_norm"),
        ("lp_lab", f"SELECT {KEYS}, {clamp(curve, 0.0, 100.0)} AS l, a * {k} AS a, bb * {k} AS bb FROM lp_masks"),
        *from_lab("lp_lab", "lp_out"),
    ]


def box_mean(source="pixels", radius=2, name="box"):
    """Separable mean over the samples that exist.  Sums along lines and columns are differences of two running sums, so the cost has no
    radius in it; windows are keyed by image and line."""

    def summed(line: str, order: str, value: str) -> tuple[str, str]:
        """Running sums and totals; the sum about each place from them."""
        over = f"OVER (PARTITION BY image_id, {line} ORDER BY {order})"
        return f"sum({value}) {over.replace(')', ' ROWS UNBOUNDED PRECEDING)')}", f"coalesce(lead(u_{value}, {radius}) {over}, last_value(u_{value}) {over.replace(')', ' ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')}) - coalesce(lag(u_{value}, {radius + 1}) {over}, 0.0e0)"

    def along(source: str, line: str, order: str, values: list[str], out: str) -> list[tuple[str, str]]:
        sums = ", ".join(f"{summed(line, order, v)[0]} AS u_{v}" for v in values)
        means = ", ".join(f"{summed(line, order, v)[1]} AS s{v}" for v in values)
        return [(f"{out}_run", f"SELECT *, {sums} FROM {source}"), (out, f"SELECT {KEYS}, r, g, b, {means} FROM {out}_run")]

    return [
        (f"{name}_in", f"SELECT {KEYS}, r, g, b, 1.0e0 AS n FROM {source}"),
        *along(f"{name}_in", "y", "x", ["r", "g", "b", "n"], f"{name}_rows"),
        *along(f"{name}_rows", "x", "y", ["sr", "sg", "sb", "sn"], f"{name}_cols"),
        (name, f"SELECT {KEYS}, r, g, b, " + ", ".join(f"ss{c} / ssn AS m{c}" for c in px.RGB) + f" FROM {name}_cols"),
    ]


def gaussian_blur(source="pixels", sigma=1.0, name="gb"):
    """Separable blur by a kernel of three sigmas to each side; weights of samples outside the image are left out."""
    radius = max(1, math.ceil(3 * sigma))
    weights = [(k, math.exp(-k * k / (2 * sigma * sigma))) for k in range(-radius, radius + 1)]

    def blurred(c: str, line: str, order: str) -> str:
        tap = lambda e, k: e if not k else f"{'lag' if k < 0 else 'lead'}({e}, {abs(k)}) OVER (PARTITION BY image_id, {line} ORDER BY {order})"
        value = " + ".join(f"{n(w)} * coalesce({tap(c, k)}, 0.0e0)" for k, w in weights)
        there = " + ".join(f"{n(w)} * coalesce({tap('one', k)}, 0.0e0)" for k, w in weights)
        return f"({value}) / ({there})"

    return [
        (f"{name}_in", f"SELECT {KEYS}, r, g, b, 1.0e0 AS one FROM {source}"),
        (f"{name}_rows", f"SELECT {KEYS}, one, " + ", ".join(f"{blurred(c, 'y', 'x')} AS {c}" for c in px.RGB) + f" FROM {name}_in"),
        mapped(f"{name}_out", f"{name}_rows", lambda c, i: blurred(c, "x", "y")),
    ]


def local_contrast(source="pixels", amount=40.0, radius=2):
    s = max(-1.0, min(1.0, amount / 100))
    return [*box_mean(source, radius, "lc"), mapped("lc_out", "lc", lambda c, i: clamp(f"{c} + ({c} - m{c}) * {n(s)}"))]


def analyzer(source="pixels"):
    """Automatic adjustments of each image: exposure, contrast, brightness, shadows, midtones, highlights, saturation."""
    first = lambda p: f"min(CASE WHEN cum > {n(p)} * (n - 1) THEN bin END) / 255.0e0"
    mass = lambda lo, hi: f"sum(CASE WHEN bin BETWEEN {lo} AND {hi} THEN c ELSE 0 END)"
    mean = lambda lo, hi: f"sum(CASE WHEN bin BETWEEN {lo} AND {hi} THEN c * (bin / 255.0e0) ELSE 0.0e0 END) / nullif({mass(lo, hi)}, 0)"
    log = "ln(greatest(lum, 0.0e0) + 1.0e-6) / ln(2.0e0)"
    return [
        ("an_lum", f"SELECT image_id, lum, greatest(0, least(255, cast(floor(lum * 255.0e0) AS int))) AS bin FROM (SELECT image_id, {px.luma()} AS lum FROM {source}) q"),
        *quantiles("an_lum", log, {"p5": 0.05, "p50": 0.5, "p95": 0.95}, "an_ev"),
        ("an_bins", "SELECT image_id, bin, count(*) AS c FROM an_lum GROUP BY image_id, bin"),
        ("an_cum", "SELECT image_id, bin, c, sum(c) OVER (PARTITION BY image_id ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY image_id) AS n FROM an_bins"),
        ("an_hist", f"SELECT image_id, {first(0.2)} AS p20, {first(0.95)} AS h95, {mass(89, 166)} / cast(max(n) AS double) AS mid, {mass(0, 63)} / cast(max(n) AS double) AS dark, {mass(217, 255)} / cast(max(n) AS double) AS light, {mean(64, 192)} AS mb, {mean(89, 166)} AS mm FROM an_cum GROUP BY image_id"),
        (
            "an_out",
            f"SELECT h.image_id, {clamp('ln(0.18e0 / (pow(2.0e0, p50) + 1.0e-6)) / ln(2.0e0)', -6.0, 6.0)} AS ev, p95 - p5 AS stops, {clamp('1.15e0 + mid * 0.45e0', 1.15, 1.6)} AS contrast, coalesce({clamp('0.5e0 / mb', 0.7, 1.4)}, 1.0e0) AS brightness, "
            f"1.0e0 + {clamp('(0.28e0 - p20) / 0.28e0')} * {clamp('(dark - 0.1e0) / 0.45e0')} * 0.35e0 AS shadows, CASE WHEN mm IS NULL THEN 1.0e0 ELSE {clamp('1.0e0 + ' + clamp('(0.5e0 - mm) / 0.5e0', -1.0, 1.0) + ' * 0.2e0', 0.9, 1.2)} END AS midtones, "
            f"1.0e0 + greatest({clamp('(light - 0.05e0) / 0.2e0')}, {clamp('(h95 - 0.85e0) / 0.15e0')}) * 0.35e0 AS highlights, {clamp('1.0e0 + (' + clamp('1.15e0 + mid * 0.45e0', 1.15, 1.6) + ' - 1.0e0) * 0.4e0', 1.0, 1.35)} AS saturation FROM an_hist h JOIN an_ev e ON h.image_id = e.image_id",
        ),
    ]


def downsample(source="gray", name="half"):
    """Means of the valid pixels of each two by two; odd tails are dropped.  Columns y, x, v, valid; w, h of each image."""
    return [(name, f"SELECT image_id, cast(y DIV 2 AS int) AS y, cast(x DIV 2 AS int) AS x, cast(coalesce(sum(v * valid) DIV nullif(sum(valid), 0), 0) AS int) AS v, max(valid) AS valid, max(w) DIV 2 AS w, max(h) DIV 2 AS h FROM {source} WHERE y < 2 * (h DIV 2) AND x < 2 * (w DIV 2) GROUP BY image_id, y DIV 2, x DIV 2")]


def threshold_bitmap(source="gray", name="bitmap"):
    """Bits above the lower median (from a histogram of the levels), masked where a value is within four of it."""
    return [
        (f"{name}_levels", f"SELECT image_id, v, count(*) AS c FROM {source} WHERE valid = 1 GROUP BY image_id, v"),
        (f"{name}_sums", f"SELECT image_id, v, sum(c) OVER (PARTITION BY image_id ORDER BY v) AS cum, sum(c) OVER (PARTITION BY image_id) AS n FROM {name}_levels"),
        (f"{name}_median", f"SELECT image_id, min(v) AS med FROM {name}_sums WHERE cum > (n - 1) DIV 2 GROUP BY image_id"),
        (name, f"SELECT p.image_id, y, x, CASE WHEN v >= med THEN 1 ELSE 0 END AS bit, CASE WHEN valid = 1 AND abs(v - med) > 4 THEN 1 ELSE 0 END AS mask FROM {source} p JOIN {name}_median m ON p.image_id = m.image_id"),
    ]
