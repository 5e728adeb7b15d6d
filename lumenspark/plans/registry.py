"""All raster queries: fixtures, steps, and a last SELECT, rendered for Spark or for the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..functions import pixel as px
from ..functions.dialect import chain, clamp, duck_text, n, r6, rounded, spark_text
from ..operators import alignment as al
from ..operators import brackets as br
from ..operators import catalog as cat
from ..operators import mapping
from ..operators import steps as op
from ..sources import settings as st
from ..sources.fixtures import closure, fixtures, series

KEYS = op.KEYS
RGB = px.RGB

#: Boxes (hue, hue, saturation, saturation, value, value, adjustment): plain, wrapped hue, full circle, no width, swapped.
RANGES = ((60.0, 180.0, 0.1, 0.9, 0.1, 1.0, 60.0), (350.0, 18.0, 0.0, 1.0, 0.2, 0.9, -40.0), (0.0, 360.0, 0.3, 0.7, 0.0, 1.0, 25.0), (30.0, 30.0, 0.0, 1.0, 0.0, 1.0, 80.0), (200.0, 260.0, 0.8, 0.2, 0.9, 0.1, -70.0))
_BOXES = tuple(st.Range(*x) for x in RANGES)
_FILTER = st.Filter("boxes", ranges=_BOXES)
#: Settings of the mapper sweep; each mapper with its core, and with the stages about it.
ACES = st.AcesSettings(key=0.27, gamma=1.15, exposure_ev=0.3, contrast=1.2, brightness=1.1, saturation=25.0)
NATURAL = st.NaturalSettings(target_gray=0.3, white_point_percentile=0.95, output_mid_gray=0.22, tonal_range_compression=3.0, gamma=1.25, auto_brightness_compensation=True, contrast=1.1, saturation=35.0, exposure_ev=0.25)
CONTRAST = st.ContrastSettings(strength=0.9, tone_compression=0.8, lighting_effect=1.1, luminance=1.3, white_clip=1.25, black_clip=0.04, saturation=20.0, saturation_filters=(_FILTER,))
BRIGHTNESS = st.BrightnessSettings(strength=0.75, lighting=1.2, brightness_boost=1.05, white_clip=1.3, black_clip=0.03, contrast=1.15)
LAB = {"exposure": 0.15, "brightness": 1.05, "shadows": 1.2, "midtones": 0.95, "highlights": 1.15, "contrast": 1.2, "vibrance": 1.3}
STAGES = {"white_balance_reference_type": "Auto", "shadows_boost": 1.3, "highlights_boost": 0.8, "dehaze": 35.0, "local_contrast": 30.0, "local_contrast_radius": 2, "color_temperature": 5200.0, "post_process": st.Lab(**LAB), "transparent": 20.0}

#: name: (fixtures, steps with the last one the result)
Q: dict[str, tuple[list[str], Callable[[bool], list[tuple[str, str]]]]] = {}


def q(name: str, needs: list[str], *steps: tuple[str, str] | str) -> None:
    Q[name] = needs, lambda spark: [s if isinstance(s, tuple) else ("result", s) for s in steps]


def pixels(source="unit", name="pixels"):
    return name, f"SELECT * FROM {source}"


def shown(source: str, columns=RGB, keys=KEYS) -> str:
    return f"SELECT {keys}, " + ", ".join(f"{r6(c)} AS {c}" for c in columns) + f" FROM {source}"


def per_pixel(name: str, source: str, **columns: str) -> None:
    q(name, [source], f"SELECT {KEYS}, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {source}")


def mapper(name: str, source: str, steps: list[tuple[str, str]]) -> None:
    q(name, [source], pixels(source), *steps, shown(steps[-1][0]))


# Scans, sources and sinks ------------------------------------------------------------------------------------------
q("scan_raster", ["raster"], f"SELECT {KEYS}, r, g, b FROM raster")
q("row_scan", ["raster"], f"SELECT {KEYS}, r, g, b FROM raster WHERE y = 17")
q("pixel_lookup", ["raster"], f"SELECT {KEYS}, r, g, b FROM raster WHERE y = 17 AND x = 5")
q("blank_raster", ["raster"], f"SELECT {KEYS}, 0 AS r, 0 AS g, 0 AS b FROM raster")
q("row_overwrite", ["raster"], ("fresh", "SELECT image_id, y, x, 255 - r AS r, 255 - g AS g, 255 - b AS b FROM raster WHERE y = 3"), "SELECT o.image_id, o.y, o.x, coalesce(f.r, o.r) AS r, coalesce(f.g, o.g) AS g, coalesce(f.b, o.b) AS b FROM raster o LEFT JOIN fresh f ON o.image_id = f.image_id AND o.y = f.y AND o.x = f.x")
q("paste_rect", ["raster"], ("block", "SELECT image_id, y + 60 AS y, x + 40 AS x, r, g, b FROM raster WHERE x < 30 AND y < 50"), "SELECT c.image_id, c.y, c.x, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b FROM raster c LEFT JOIN block p ON c.image_id = p.image_id AND c.y = p.y AND c.x = p.x")
per_pixel("normalize_unit", "raster", **{c: r6(f"{c} / 255.0e0") for c in RGB})
q("quantize_bytes", ["hdr"], f"SELECT {KEYS}, " + ", ".join(f"cast(greatest(0.0e0, least(255.0e0, ROUND_EVEN({c} * 100.0e0, 0))) AS int) AS {c}" for c in RGB) + " FROM hdr")

# Per-pixel maps ----------------------------------------------------------------------------------------------------
per_pixel("luminance", "unit", lum=r6(px.luma()))
per_pixel("gray_mtb", "raster", gray=f"cast({px.gray_byte()} AS int)")
per_pixel("rgb_arith", "unit", diff=r6("r - g"), ratio=r6("r / (g + 0.5e0)"), inverse=r6("2.0e0 / (b + 0.25e0)"), part=r6("g / 3.0e0"), product=r6("r * b"), scaled=r6("g * 1.7e0"))
q("weight_lut", ["raster"], ("levels", f"SELECT {' AS z FROM raster UNION ALL SELECT '.join(RGB)} AS z FROM raster"), f"SELECT z, {r6(px.hat_weight('z'))} AS w, count(*) AS n FROM levels GROUP BY z")
per_pixel("midtone_weight", "unit", w=r6(px.midtone_weight("r")), w3=r6(px.midtone_weight("g", 3.0)))
per_pixel("aces_curve", "hdr", **{c: r6(px.aces_curve(f"({c} - 0.5e0)")) for c in RGB})
per_pixel("aces_matrix", "unit", **{f"i{i}": r6(px.dot(px.ACES_IN[i], RGB)) for i in range(3)}, **{f"o{i}": r6(px.dot(px.ACES_OUT[i], RGB)) for i in range(3)})
per_pixel("adjust_contrast", "unit", **{c: r6(px.contrast(c, 1.6)) for c in RGB})
per_pixel("smoothstep", "unit", s=r6(px.smoothstep(0.2, 0.7, "r")), l=r6(px.lerp("r", "g", "b")))
per_pixel("gamma", "unit", **{c: r6(px.gamma(c, 2.2)) for c in RGB}, floor_gamma=r6(px.gamma("r", 0.01)))
per_pixel("saturate", "unit", **{c: r6(px.saturate(c, px.luma(), "1.4e0")) for c in RGB})
per_pixel("vibrance", "unit", v=r6(px.vibrance("1.6e0", px.hsv()[1])), low=r6(px.vibrance("0.7e0", px.hsv()[1])))
per_pixel("rgb_to_hsv", "unit", **dict(zip(("h", "s", "v"), (rounded(c, k) for c, k in zip(px.hsv(), (4, 7, 7), strict=True)), strict=True)))
mapper("saturation_ranges", "unit", op.saturation_ranges("pixels", RANGES))
q("tone_boost", ["unit"], ("boost", f"SELECT *, {px.tone_boost(px.luma(), 1.5, 1.1, 0.6)} AS k FROM unit"), f"SELECT {KEYS}, " + ", ".join(f"{r6(clamp(f'{c} * k'))} AS {c}" for c in RGB) + " FROM boost")
q("dehaze", ["unit"], ("dark", f"SELECT *, {px.floor_of()} AS d FROM unit"), f"SELECT {KEYS}, " + ", ".join(f"{r6(px.dehaze(c, 'd', 60.0))} AS {c}" for c in RGB) + " FROM dark")
per_pixel("color_temperature", "unit", **{c: r6(clamp(f"{c} * {n(k)}")) for c, k in zip(RGB, px.temperature(4200), strict=True)}, **{f"cool_{c}": r6(clamp(f"{c} * {n(k)}")) for c, k in zip(RGB, px.temperature(9000), strict=True)})
per_pixel("blend_source", "unit", **{c: r6(f"{px.contrast(c, 1.5)} * {n(0.65)} + {c} * {n(0.35)}") for c in RGB})
per_pixel("srgb_linear", "unit", **{f"lin_{c}": r6(px.to_linear(c)) for c in RGB}, **{f"srgb_{c}": r6(px.to_srgb(c)) for c in RGB})
q("rgb_to_lab", ["unit"], pixels(), *op.to_lab(), f"SELECT {KEYS}, {r6('l')} AS l, {r6('a')} AS a, {r6('bb')} AS b FROM lab")
mapper("lab_roundtrip", "unit", [*op.to_lab(), *op.from_lab()])
_hi, _lo = px.peak(), px.floor_of()
q("rgb_to_hsl", ["unit"], ("ext", f"SELECT *, {_hi} AS hi, {_lo} AS lo, {_hi} - {_lo} AS d FROM unit"), f"SELECT {KEYS}, {rounded('CASE WHEN d <= 1.0e-8 THEN 0.0e0 WHEN abs(hi - r) < 1.0e-8 THEN 60.0e0 * ((g - b) / d + CASE WHEN g < b THEN 6.0e0 ELSE 0.0e0 END) WHEN abs(hi - g) < 1.0e-8 THEN 60.0e0 * ((b - r) / d + 2.0e0) ELSE 60.0e0 * ((r - g) / d + 4.0e0) END', 4)} AS h, {r6('CASE WHEN d <= 1.0e-8 THEN 0.0e0 WHEN (hi + lo) / 2.0e0 < 0.5e0 THEN d / (hi + lo) ELSE d / (2.0e0 - hi - lo) END')} AS s, {r6('(hi + lo) / 2.0e0')} AS l FROM ext")
#: Channels by sector of 60 degrees: the chroma c, the second largest part x2, nothing.
_SECTORS = (
    "CASE sector WHEN 0 THEN c WHEN 1 THEN x2 WHEN 2 THEN 0.0e0 WHEN 3 THEN 0.0e0 WHEN 4 THEN x2 WHEN 5 THEN c END",
    "CASE sector WHEN 0 THEN x2 WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN x2 WHEN 4 THEN 0.0e0 WHEN 5 THEN 0.0e0 END",
    "CASE sector WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.0e0 WHEN 2 THEN x2 WHEN 3 THEN c WHEN 4 THEN c WHEN 5 THEN x2 END",
)
q(
    "hsl_to_rgb", ["unit"],
    ("hsl", "SELECT image_id, y, x, r * 359.0e0 AS h, g AS s, b AS l FROM unit"),
    ("parts", "SELECT *, (1.0e0 - abs(2.0e0 * l - 1.0e0)) * s AS c, cast(floor(h / 60.0e0) AS int) AS sector, h / 60.0e0 - floor(h / 60.0e0) AS frac FROM hsl"),
    ("sectors", "SELECT *, c * (1.0e0 - abs(2.0e0 * frac - 1.0e0)) AS x2, l - c / 2.0e0 AS m FROM parts"),
    f"SELECT {KEYS}, " + ", ".join(f"{r6(f'greatest(0.0e0, least(255.0e0, (({_SECTORS[i]}) + m) * 255.0e0))')} AS {c}" for i, c in enumerate(RGB)) + " FROM sectors",
)
per_pixel("brightness_shift", "unit", **{c: r6(clamp(f"{c} + {n(0.15)}")) for c in RGB})
per_pixel("ed_contrast", "unit", **{c: r6(px.contrast(c, 1.25)) for c in RGB})
per_pixel("ed_brightness", "unit", **{c: r6(clamp(f"{c} * {n(1.2)}")) for c in RGB})
per_pixel("ed_saturation", "unit", **{c: r6(clamp(px.saturate(c, px.luma(), n(0.6)))) for c in RGB})
per_pixel("ed_gray", "unit", gray=r6(px.luma()))
per_pixel("ed_threshold", "unit", bit=f"CASE WHEN {px.luma()} >= {n(0.2)} THEN 1 ELSE 0 END")
mapper("gaussian_blur", "unit", op.gaussian_blur(sigma=1.5))
q("ed_binary_map", ["unit"], ("pixels", f"SELECT {KEYS}, bit AS r, bit AS g, bit AS b FROM (SELECT {KEYS}, CASE WHEN {px.luma()} >= {n(0.2)} THEN 1.0e0 ELSE 0.0e0 END AS bit FROM unit) t"), *op.gaussian_blur(sigma=0.8), f"SELECT {KEYS}, {r6('r')} AS v FROM gb_out")
per_pixel("log_radiance", "unit", v=r6(f"ln({px.luma()} + 1.0e-6) - ln({n(1 / 60)})"))
Q["resize_nearest"] = ["raster"], lambda spark: [("ys", series("oy", 0, 49, spark)), ("xs", series("ox", 0, 39, spark)), ("grid", "SELECT oy, ox, cast(floor((oy + 0.5e0) * 2.0e0) AS int) AS y, cast(floor((ox + 0.5e0) * 1.6e0) AS int) AS x FROM ys CROSS JOIN xs"), ("result", "SELECT image_id, oy AS y, ox AS x, r, g, b FROM raster JOIN grid USING (y, x)")]
# Tags that are missing are filled from the shutter and aperture values, but the light of a frame needs all three tags themselves.
_t = f"CASE WHEN exposure_time IS NOT NULL THEN exposure_time WHEN shutter_speed_value IS NOT NULL THEN ROUND_EVEN(1.0e6 * pow(2.0e0, -shutter_speed_value), 0) / 1.0e6 END"
_f = "coalesce(f_number, CASE WHEN pow(2.0e0, aperture_value / 2.0e0) > 0.0e0 THEN pow(2.0e0, aperture_value / 2.0e0) ELSE -1.0e0 END)"
q(
    "exif_photometry", ["exif"],
    ("filled", f"SELECT *, {_t} AS t, {_f} AS f, coalesce(iso, 100.0e0) AS i FROM exif"),
    f"SELECT frame_id, {r6('CASE WHEN f_number IS NULL OR exposure_time IS NULL THEN -100000.0e0 ELSE t END')} AS exposure_time, {r6('f')} AS f_number, i AS iso, "
    f"{r6('CASE WHEN iso IS NULL OR f_number IS NULL OR exposure_time IS NULL THEN -1.0e0 ELSE ln(t) + ln(i / 100.0e0) - 2.0e0 * ln(f) END')} AS log_exposure, {r6('ln(f * f / t * i) / ln(2.0e0)')} AS ev, bias, make, model FROM filled",
)

q("load_channels", ["raster", "level"], f"SELECT {KEYS}, z AS channel, cast(CASE z WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS double) AS v FROM raster CROSS JOIN level WHERE z < 3")
q("metadata_copy", ["exif"], ("copies", "SELECT frame_id + 1000000 AS frame_id, frame_id AS source_id FROM exif"), f"SELECT c.frame_id, {r6('e.exposure_time')} AS exposure_time, f_number, iso, bias, make, model FROM copies c JOIN exif e ON c.source_id = e.frame_id")

# Aggregates --------------------------------------------------------------------------------------------------------
q("target_brightness", ["bracket"], ("each", f"SELECT image_id, frame, avg({px.luma()} / 255.0e0) AS m FROM bracket GROUP BY image_id, frame"), f"SELECT image_id, {r6(clamp('avg(m)'))} AS target FROM each GROUP BY image_id")
q("brightness_stats", ["hdr"], f"SELECT image_id, {r6(f'avg({px.luma()})')} AS mean, {r6(f'max({px.luma()})')} AS top, {r6(f'max({_hi})')} AS channel, {r6(f'1.0e0 / greatest(max({_hi}), 1.0e-6)')} AS scale FROM hdr GROUP BY image_id")
q("normalize_untonemapped", ["hdr"], pixels("hdr"), op.stats("hdr", f"0.4e0 / greatest(avg({px.luma()}), 1.0e-6) * 255.0e0 AS k", "s"), f"SELECT p.image_id, y, x, {', '.join(f'{r6(f"{c} * k")} AS {c}' for c in RGB)} FROM hdr p JOIN s ON p.image_id = s.image_id")
q("log_average", ["hdr"], f"SELECT image_id, {r6(op.LOG_AVERAGE)} AS a FROM hdr GROUP BY image_id")
q("auto_exposure_aces", ["hdr"], f"SELECT image_id, {r6(f'0.18e0 / (exp(avg(ln(1.0e-4 + {px.luma()}))) + 1.0e-9)')} AS exposure FROM hdr GROUP BY image_id")
q("input_scale", ["hdr"], f"SELECT image_id, {r6(f'CASE WHEN max({_hi}) <= 1.0001e0 THEN 1.0e0 ELSE 0.18e0 / exp(avg(ln(greatest({px.luma()}, 1.0e-9)))) END')} AS scale FROM hdr GROUP BY image_id")
q("percentile_lum", ["unit"], *op.quantiles("unit", px.luma(), {"p98": 0.98, "p50": 0.5}, "pct"), f"SELECT image_id, {r6('p98')} AS p98, {r6('p50')} AS p50 FROM pct")
_bins = ("bins", f"SELECT image_id, greatest(0, least(255, cast(floor({px.luma()} * 255.0e0) AS int))) AS bin FROM unit")
q("histogram256", ["unit", "level"], _bins, ("images", "SELECT DISTINCT image_id FROM bins"), ("counts", "SELECT image_id, bin, count(*) AS c FROM bins GROUP BY image_id, bin"), "SELECT i.image_id, z AS bin, coalesce(c, 0) AS c FROM images i CROSS JOIN level LEFT JOIN counts k ON k.image_id = i.image_id AND k.bin = z")
q("hist_percentile", ["unit"], _bins, ("counts", "SELECT image_id, bin, count(*) AS c FROM bins GROUP BY image_id, bin"), ("cum", "SELECT image_id, bin, sum(c) OVER (PARTITION BY image_id ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY image_id) AS total FROM counts"), "SELECT image_id, " + ", ".join(f"{r6(f'min(CASE WHEN cum > {n(p)} * (total - 1) THEN bin END) / 255.0e0')} AS p{int(100 * p)}" for p in (0.2, 0.5, 0.95)) + " FROM cum GROUP BY image_id")
q("auto_ev", ["unit"], pixels(), *op.analyzer(), f"SELECT image_id, {r6('ev')} AS ev, {r6('stops')} AS stops FROM an_out")
q("image_analyzer", ["unit"], pixels(), *op.analyzer(), "SELECT image_id, " + ", ".join(f"{r6(c)} AS {c}" for c in ("ev", "stops", "contrast", "brightness", "shadows", "midtones", "highlights", "saturation")) + " FROM an_out")
q("auto_adjust", ["unit"], pixels(), *op.analyzer(), f"SELECT image_id, {r6('greatest(ev, 0.0e0)')} AS ev, {r6('greatest(brightness, 1.0e0)')} AS brightness, {r6('shadows')} AS shadows, {r6('greatest(midtones, 1.0e0)')} AS midtones FROM an_out")
mapper("white_balance_auto", "unit", op.white_balance())
mapper("white_balance_ref", "unit", op.white_balance(reference="gray", colour=(0.25, 0.5, 1.0)))
q("lab_range", ["unit"], pixels(), *op.to_lab(), f"SELECT image_id, {r6('min(l)')} AS lo, {r6('max(l)')} AS hi FROM lab GROUP BY image_id")
q("rgb_minmax", ["raster"], "SELECT image_id, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in RGB) + " FROM raster GROUP BY image_id")
q("vibrance_stats", ["unit"], ("cm", f"SELECT image_id, {px.luma()} AS l, {_hi} - {_lo} AS c FROM unit"), f"SELECT image_id, {r6('sum(l)')} AS l_sum, {r6('sum(l * l)')} AS l_sum2, {r6('sum(c)')} AS c_sum, {r6('max(c)')} AS c_max, count(*) AS n FROM cm GROUP BY image_id")
q("white_pct", ["bracket"], f"SELECT image_id, frame, {r6('avg(CASE WHEN r = 255 AND g = 255 AND b = 255 THEN 100.0e0 ELSE 0.0e0 END)')} AS pct FROM bracket GROUP BY image_id, frame")
q("image_diff", ["bracket"], ("d", "SELECT p.image_id, abs(p.r - q.r) AS d FROM bracket p JOIN bracket q ON p.image_id = q.image_id AND p.y = q.y AND p.x = q.x WHERE p.frame = 0 AND q.frame = 2"), f"SELECT image_id, {r6('avg(d)')} AS mean, max(d) AS top, cast(percentile_disc(0.99) WITHIN GROUP (ORDER BY d) AS int) AS p99 FROM d GROUP BY image_id")

# Tone mapping ------------------------------------------------------------------------------------------------------
def settings_query(name: str, source: str, settings: st.Settings, hdr: bool = False, scene: float = 0.24) -> None:
    """Settings in the order of the mapping, values rounded."""
    mapper(name, source, mapping.plan(settings, hdr=hdr, scene=scene))


mapper("tonemap_natural_ldr", "unit", op.natural(gamma=1.25, compensate=True, out_gray=0.22, contrast=1.1, saturation=35.0, ev=0.25, ranges=RANGES))
settings_query("tonemap_natural_compressed", "unit", replace(NATURAL, bypass_tone_compression_for_ldr=False))
settings_query("tonemap_natural_bounded", "unit", replace(NATURAL, ldr_bypass_white_point_threshold=0.93))
settings_query("tonemap_natural_hdr", "hdr", NATURAL, hdr=True, scene=0.35)
settings_query("tonemap_aces", "unit", ACES)
settings_query("tonemap_aces_hdr", "hdr", ACES, hdr=True)
settings_query("tonemap_brightness", "unit", BRIGHTNESS)
settings_query("tonemap_contrast", "unit", CONTRAST)
settings_query("base_order_natural", "unit", replace(NATURAL, **STAGES))
settings_query("base_order_contrast", "unit", replace(CONTRAST, **STAGES))
settings_query("base_order_core_skipped", "unit", st.BrightnessSettings(exposure_ev=0.2, brightness=1.1, saturation=-20.0, saturation_filters=(_FILTER,), **STAGES))
settings_query("base_order_hdr", "hdr", replace(ACES, **STAGES), hdr=True)
settings_query("auto_adjusted", "unit", st.NaturalSettings(auto_adjust_enabled=True, post_process=st.Lab(midtones=1.1)))
mapper("lab_post", "unit", op.lab_post(**LAB))
mapper("box_mean", "unit", [*op.box_mean(radius=3), op.mapped("means", "box", lambda c, i: f"m{c}")])
mapper("local_contrast", "unit", op.local_contrast(amount=45.0, radius=3))
_single = mapping.plan(replace(NATURAL, **STAGES))
q("single_pipeline", ["unit"], pixels(), *_single, mapping.quantized(_single[-1][0]))

# Brackets ----------------------------------------------------------------------------------------------------------
MASKED = [br.framed(), br.masked(br.motion_alpha(50.0))]
q("motion_mask", ["bracket"], *MASKED, f"SELECT {KEYS}, {r6('m')} AS m FROM masked")
_motion = px.motion_weight(f"abs({px.luma('r1', 'g1', 'b1')} - {px.luma('r0', 'g0', 'b0')}) / 255.0e0", 2.0)
q("motion_replace", ["bracket"], br.framed(), ("weighed", f"SELECT *, {_motion} * {px.midtone_weight(f'({px.luma("r1", "g1", "b1")} / 255.0e0)')} AS w FROM framed"), f"SELECT {KEYS}, " + ", ".join(f"CASE WHEN w <= 0.5e0 THEN {c}0 ELSE {c}1 END AS {c}" for c in RGB) + " FROM weighed")
q("lut_lookup", ["raster", "response"], f"SELECT {KEYS}, {r6('w')} AS w, {r6('p.g')} AS g FROM raster JOIN (SELECT z, g, w FROM response) p ON r = z")
MERGE = [*MASKED, *br.merged(lambda c, z: f"ln(({z} + 0.5e0) / 128.5e0)")]
q("merge_radiance", ["bracket"], *MERGE, f"SELECT {KEYS}, " + ", ".join(f"{r6(c)} AS {c}" for c in RGB) + " FROM merged")
_hdr = mapping.plan(replace(NATURAL, white_balance_reference_type="Auto"), "lit", hdr=True, scene="scene")
q("hdr_tonemapped", ["bracket"], *MERGE, br.scene(), ("lit", "SELECT m.*, scene FROM merged m JOIN scene s ON m.image_id = s.image_id"), *_hdr, shown(_hdr[-1][0]))
q("fallback_frame", ["bracket"], "SELECT image_id, min_by(frame, loge) AS darkest FROM (SELECT DISTINCT image_id, frame, loge FROM bracket) f GROUP BY image_id")
SAMPLE = [*MASKED, *br.sample(500)]
q("stratified_sample", ["bracket"], *SAMPLE, f"SELECT {KEYS}, bin FROM sample")
q("grid_sample", ["raster"], f"SELECT {KEYS}, r, g, b FROM raster WHERE x % 5 = 0 AND y % 5 = 0")
q("sample_lookup", ["bracket", "frame"], *SAMPLE, f"SELECT image_id, frame, y, x, " + ", ".join(f"CASE frame WHEN 0 THEN {c}0 WHEN 1 THEN {c}1 ELSE {c}2 END AS {c}" for c in RGB) + " FROM sample CROSS JOIN frame")
NORMAL = [*SAMPLE, *br.normal_equations()]
q("response_normal_matrix", ["bracket"], *NORMAL, f"SELECT image_id, channel, z, zz, {r6('sum(v)')} AS v FROM cells WHERE zz >= 0 GROUP BY image_id, channel, z, zz")
q("response_smoothness", ["level", "bracket"], ("images", "SELECT DISTINCT image_id FROM bracket"), ("rows", f"SELECT z, 500.0e0 * {px.hat_weight('(z + 1)')} AS k FROM level WHERE z <= 253"), ("taps", "SELECT z AS i, 0 AS o, 1.0e0 AS c FROM rows UNION ALL SELECT z AS i, 1 AS o, -2.0e0 AS c FROM rows UNION ALL SELECT z AS i, 2 AS o, 1.0e0 AS c FROM rows"), f"SELECT image_id, p.i + p.o AS z, q.i + q.o AS zz, {r6('sum(p.c * q.c * k * k)')} AS v FROM taps p JOIN taps q ON p.i = q.i JOIN rows ON z = p.i CROSS JOIN images GROUP BY image_id, p.i + p.o, q.i + q.o")

# Alignment ---------------------------------------------------------------------------------------------------------
W, H = 64, 100
q("pyramid_downsample", ["gray"], *op.downsample(), "SELECT image_id, y, x, v, valid FROM half")
q("pyramid_levels", ["gray"], *al.pyramid("gray", W, H, "lv"), " UNION ALL ".join(f"SELECT {k} AS level, image_id, y, x, cast(v AS int) AS v, valid FROM lv{k}" for k in range(al.levels(W, H))))
q("mtb_median", ["gray"], *op.threshold_bitmap(), "SELECT image_id, cast(med AS int) AS med FROM bitmap_median")
q("mtb_bitmap", ["gray"], *op.threshold_bitmap(), f"SELECT {KEYS}, bit, mask FROM bitmap")
_small = [*op.downsample(), *op.threshold_bitmap("half", "ref"), ("cand_full", "SELECT image_id, y + 2 AS y, x - 3 AS x, v, valid FROM half WHERE y + 2 < 50 AND x >= 3"), *op.threshold_bitmap("cand_full", "cand"), ("pairs", "SELECT DISTINCT image_id, image_id AS ref_id, 0 AS cx, 0 AS cy FROM cand"), *al.tiles("ref", "ref_tiles"), *al.tiles("cand", "cand_tiles"), *al.scores("ref_tiles", "cand_tiles", "pairs", "scores")]
q("shift_scores", ["gray"], *_small, "SELECT image_id, dx, dy, mismatch, valid FROM scores")
q("best_shift", ["gray"], *_small, *al.best("scores", "pairs", "best"), "SELECT image_id, dx, dy, mismatch, valid FROM best")
#: Candidates: each image moved by whole pixels that depend on it, and two of its frames in other exposures turned by a degree or two.
_moved = ("moved", f"SELECT image_id, y + 5 - cast(image_id % 11 AS int) AS y, x + cast(image_id % 7 AS int) - 3 AS x, v, valid, {W} AS w, {H} AS h FROM gray WHERE y + 5 - cast(image_id % 11 AS int) BETWEEN 0 AND {H - 1} AND x + cast(image_id % 7 AS int) - 3 BETWEEN 0 AND {W - 1}")
_translation = [("ref_gray", f"SELECT image_id, y, x, v, 1 AS valid, {W} AS w, {H} AS h FROM gray"), _moved, *al.translation("ref_gray", "moved", W, H)]
q("align_translation", ["gray"], *_translation, f"SELECT image_id, dx, dy, {r6('score')} AS score FROM translation")
_half = ("shifted", f"SELECT image_id, y, x, v0 + ((v1 - v0) DIV 2) AS v, 1 AS valid, {W} AS w, {H} AS h FROM (SELECT image_id, y, x, v AS v0, coalesce(lead(v) OVER (PARTITION BY image_id, y ORDER BY x), v) AS v1 FROM smooth) t")
_subpixel = [_half, ("centres", "SELECT DISTINCT image_id, 0 AS dx, 0 AS dy FROM smooth"), *al.subpixel("smooth", "shifted", "centres", W, H, stride=4)]
q("subpixel_corr", ["smooth"], *_subpixel, f"SELECT image_id, dx, dy, {r6('corr')} AS corr FROM correlations")
q("subpixel_refine", ["smooth"], *_subpixel, f"SELECT image_id, dx, dy, {r6('corr')} AS corr FROM refined")
_two = ("transforms", f"SELECT DISTINCT image_id, 0.0e0 AS dx, 0.0e0 AS dy, {n(al.cos(2.0))} AS c, {n(al.sin(2.0))} AS s FROM raster")
q("rotate_nearest", ["gray"], ("near", f"SELECT image_id, y, x, {al.turned('x', 'y', 2.0, W, H)} FROM gray"), "SELECT p.image_id, p.y, p.x, cast(coalesce(g.v, 0) AS int) AS v, coalesce(g.valid, 0) AS valid FROM near p LEFT JOIN gray g ON p.image_id = g.image_id AND p.ny = g.y AND p.nx = g.x")
for _name, _fill in (("resample_bilinear", None), ("resample_fill", "own")):
    q(_name, ["raster"], _two, *al.resampled("raster", "transforms", W, H, _fill), f"SELECT {KEYS}, " + ", ".join(f"{r6(c)} AS {c}" for c in RGB) + " FROM resampled")
_candidate = ("candidate", f"SELECT image_id, y + 5 - cast(image_id % 11 AS int) AS y, x + cast(image_id % 7 AS int) - 3 AS x, r, g, b FROM raster WHERE y + 5 - cast(image_id % 11 AS int) BETWEEN 0 AND {H - 1} AND x + cast(image_id % 7 AS int) - 3 BETWEEN 0 AND {W - 1}")
q("align_pipeline", ["gray", "raster"], *_translation, _candidate, ("transforms", "SELECT image_id, cast(dx AS double) AS dx, cast(dy AS double) AS dy, 1.0e0 AS c, 0.0e0 AS s FROM translation"), *al.resampled("candidate", "transforms", W, H, "raster"), f"SELECT {KEYS}, " + ", ".join(f"{r6(c)} AS {c}" for c in RGB) + " FROM resampled")
q("corr_overlap", ["gray"], ("overlap", "SELECT p.image_id, cast(p.v AS double) AS a, cast(q.v AS double) AS b FROM gray p JOIN gray q ON p.image_id = q.image_id AND p.y = q.y - 2 AND p.x = q.x + 3 WHERE p.valid = 1 AND q.valid = 1"), ("sums", "SELECT image_id, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM overlap GROUP BY image_id"), f"SELECT image_id, {r6('(n * ab - a * b) / sqrt((n * aa - a * a) * (n * bb - b * b))')} AS corr, n FROM sums")
q("rect_intersect", ["raster"], "SELECT DISTINCT x AS a, y AS b, greatest(x, 20) AS l, greatest(y, 30) AS t, greatest(0, least(x + 15, 50) - greatest(x, 20)) AS w, greatest(0, least(y + 25, 70) - greatest(y, 30)) AS h FROM raster")

# Catalog -----------------------------------------------------------------------------------------------------------
q("catalog_scan", ["catalog"], *cat.listed("catalog"), "SELECT folder, path, bias, width, height FROM listed")
q("series_catalog", ["catalog"], *cat.series("catalog"), "SELECT folder, first_path, width, height, members, biases FROM groups")
q("series_singles", ["catalog"], *cat.series("catalog"), "SELECT folder, path FROM singles")
q("series_merge_named", ["catalog"], *cat.series("catalog"), *cat.named(), "SELECT folder, first_path, path FROM merged_named")


def render(name: str, spark: bool, sf_dir: str = "") -> str:
    needs, steps = Q[name]
    return (spark_text if spark else duck_text)(chain([*closure(needs, fixtures(spark, sf_dir)), *steps(spark)]))


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(render(name, True, sf_dir))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["tonemap_natural_hdr"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import aligned, response

    return {name: _query(name) for name in Q} | response.QUERIES | aligned.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import aligned, response

    return {name: render(name, False) for name in Q} | {"lstsq_small": duck_text(chain([*closure(["unit"], fixtures(False, "")), *response.plane()]))} | aligned.oracle_sql()
