"""Raster queries against the oracle's SQL, and against versions and answers that don't share its text; settings; the stream."""

from dataclasses import fields, replace

import brute_raster as brute
import duckdb
import numpy as np
import pytest

from lumenspark.functions import pixel as px
from lumenspark.functions.dialect import spark_text
from lumenspark.operators import alignment, mapping, steps
from lumenspark.plans import registry, response
from lumenspark.sources import settings as st

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (ours, theirs))
    assert ((a == b) | (a.isna() & b.isna())).all().all()


def frame(spark, image):
    """Pixels of an array (h, w, 3)."""
    h, w, _ = image.shape
    return spark.createDataFrame([(0, y, x, *map(float, image[y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, r double, g double, b double")


def array(df):
    rows = df.select("y", "x", "r", "g", "b").toPandas()
    out = np.zeros((rows.y.max() + 1, rows.x.max() + 1, 3))
    out[rows.y, rows.x] = rows[["r", "g", "b"]]
    return out


def image(h=6, w=7, seed=3):
    """A dark to bright ramp with noise of every hue."""
    ramp = np.linspace(0.03, 0.93, h * w).reshape(h, w, 1)
    return np.clip(ramp + np.random.default_rng(seed).uniform(-0.12, 0.12, (h, w, 3)), 0.01, 0.99)


def run(spark, pixels, plan):
    out = steps.apply(frame(spark, np.array([pixels])), [*plan, ("result", f"SELECT * FROM {plan[-1][0]}")])
    return [(r.r, r.g, r.b) for r in out.orderBy("x").collect()]


FILTER = st.Filter("own", ranges=tuple(st.Range(*x) for x in registry.RANGES))
MAPPERS = {"natural": (st.NaturalSettings, brute.natural), "aces": (st.AcesSettings, brute.aces), "contrast": (st.ContrastSettings, brute.balanced)}
CORES = {"natural": {"auto_brightness_compensation": True, "output_mid_gray": 0.3}, "aces": {"key": 0.25}, "contrast": {"strength": 0.8, "tone_compression": 0.7, "black_clip": 0.05, "white_clip": 1.2}}


@pytest.mark.parametrize("core", [True, False])
@pytest.mark.parametrize("name", list(MAPPERS))
def test_base_order_against_arrays(spark, name, core):
    kind, mapper = MAPPERS[name]
    s = kind(exposure_ev=0.2, brightness=1.05, contrast=1.1, saturation=20.0, saturation_filters=() if name == "aces" and core else (FILTER,), **registry.STAGES, **(CORES[name] | {"gamma": 1.2} if core else {}))
    p = image()
    assert np.abs(array(mapping.tone_map(frame(spark, p), s)) - brute.mapped(p, s, mapper)).max() < 1e-9


CHANGES = {
    "auto_adjust_enabled": True, "exposure_ev": 0.7, "brightness": 1.2, "contrast": 1.3, "shadows_boost": 1.4, "midtones_boost": 1.2, "highlights_boost": 0.7, "dehaze": 60.0, "local_contrast": 50.0,
    "saturation": 40.0, "saturate_excludes": FILTER.ranges, "saturation_filters": (FILTER,), "skin_filter": replace(st.SKIN, enabled=True), "gray_color_filter": replace(st.GRAY, enabled=True), "gamma": 1.5,
    "color_temperature": 3000.0, "white_balance_reference_type": "Gray", "post_process": st.Lab(midtones=1.3), "key": 0.3, "auto_brightness_compensation": True, "bypass_tone_compression_for_ldr": False,
    "tone_compression": 0.6, "lighting_effect": 1.3, "luminance": 1.5, "lighting": 1.3, "brightness_boost": 1.2, "white_clip": 1.4, "black_clip": 0.1,
}


@pytest.mark.parametrize("kind", list(st.TYPES.values()))
def test_every_setting_has_an_effect(spark, kind):
    p = image(4, 5)
    df = frame(spark, p).cache()
    assert kind().is_neutral() and mapping.tone_map(df, kind()) is df
    known, shared, turn = {f.name for f in fields(kind)}, {f.name for f in fields(st.Settings)}, list(st.TYPES.values()).index(kind)
    for i, (name, value) in enumerate(CHANGES.items()):
        if name in known and (name not in shared or i % 4 == turn):  # what all share takes turns
            s = kind(**{name: value})
            assert not s.is_neutral(), name
            assert np.abs(array(mapping.tone_map(df, s)) - p).max() > 1e-4, name
    # these need another setting beside them
    for base, name, value in ((kind(dehaze=60.0), "transparent", 50.0), (kind(local_contrast=50.0), "local_contrast_radius", 3), (kind(white_balance_reference_type="Gray"), "white_balance_reference_color", st.Color(0.2, 0.5, 0.9))):
        assert np.abs(array(mapping.tone_map(df, replace(base, **{name: value}))) - array(mapping.tone_map(df, base))).max() > 1e-4, name
    if kind is st.NaturalSettings:
        base = kind(bypass_tone_compression_for_ldr=False, auto_brightness_compensation=True, white_point_percentile=0.9)
        for name, value in (("target_gray", 0.4), ("white_point_percentile", 0.5), ("output_mid_gray", 0.4), ("tonal_range_compression", 1.0)):
            assert np.abs(array(mapping.tone_map(df, replace(base, **{name: value}))) - array(mapping.tone_map(df, base))).max() > 1e-4, name


@pytest.mark.parametrize("kind", list(st.TYPES.values()))
@pytest.mark.parametrize(("control", "sweep"), [("exposure_ev", [float(x) for x in range(-10, 11, 2)]), ("brightness", [1.0, 1.05, 1.1, 1.3, 1.6])])
def test_monotone(spark, kind, control, sweep):
    df = frame(spark, image(4, 5)).cache()
    means = [mapping.tone_map(df, kind(**{control: v})).selectExpr(f"avg({px.luma()}) AS m", f"{i} AS i") for i, v in enumerate(sweep)]
    found = means[0]
    for other in means[1:]:
        found = found.unionByName(other)
    got = [r.m for r in found.orderBy("i").collect()]
    assert all(b >= a - 1e-5 for a, b in zip(got, got[1:], strict=False)) and got[-1] > got[0]


@pytest.mark.parametrize("kind", list(st.TYPES.values()))
def test_auto_adjust_keeps_manual_controls(spark, kind):
    df = frame(spark, image()).cache()
    mean = lambda **k: mapping.tone_map(df, kind(auto_adjust_enabled=True, **k)).selectExpr(f"avg({px.luma()})").first()[0]
    auto = mean()
    assert auto > 0.05 and mean(exposure_ev=1.0) >= auto - 1e-5 and mean(brightness=1.25) >= auto - 1e-5


@pytest.mark.parametrize(
    ("pixel", "args", "expected"),
    [((0.8, 0.4, 0.2), {}, (0.64, 0.46666667, 0.24)), ((0.3, 0.4, 0.5), {"reference": "black", "colour": (0.02, 0.04, 0.01)}, (0.3, 0.2, 1.0)), ((0.25, 0.5, 0.75), {"reference": "gray", "colour": (0.25, 0.5, 1.0)}, (0.5, 0.5, 0.375))],
)
def test_white_balance(spark, pixel, args, expected):
    assert run(spark, [pixel], steps.white_balance(**args))[0] == pytest.approx(expected, abs=1e-5)


def value(spark, text):
    return spark.sql(f"SELECT {spark_text(text)} AS v").first().v


def test_known_scalars(spark):
    assert value(spark, px.contrast("0.25e0", 2.0)) == 0 and value(spark, px.contrast("0.5e0", 2.0)) == pytest.approx(0.5)
    assert px.contrast("v", 1.0) == "v" and value(spark, px.aces_curve("(-1.0e0)")) == pytest.approx(0, abs=1e-6)
    assert px.saturation_multiplier(-50) == 0.5 and px.saturation_multiplier(50) == 2.0
    combined = st.Lab(exposure=0.5, brightness=1.1).combine(st.Lab(exposure=-0.25, brightness=1.2))
    assert combined.exposure == pytest.approx(0.25) and combined.brightness == pytest.approx(1.32)


@pytest.mark.parametrize(("values", "valid", "median", "mask"), [((0, 0, 0, 255, 255), (1, 1, 1, 1, 1), 0, None), ((0, 100, 200), (0, 1, 1), 100, [0, 0, 1]), ((7, 9), (1, 1), 7, None)])
def test_threshold_bitmap(spark, values, valid, median, mask):
    gray = spark.createDataFrame([(0, 0, x, v, k) for x, (v, k) in enumerate(zip(values, valid, strict=True))], "image_id long, y int, x int, v int, valid int")
    chain = steps.threshold_bitmap("pixels")
    rows = steps.apply(gray, [*chain, ("result", "SELECT b.x, b.mask, m.med FROM bitmap b JOIN bitmap_median m ON b.image_id = m.image_id")]).orderBy("x").collect()
    assert rows[0].med == median and (mask is None or [r.mask for r in rows] == mask)


def test_natural_bypass_is_identity(spark):
    pixels = [(0.8, 0.4, 0.2), (0.4, 0.2, 0.1)]
    for got, want in zip(run(spark, pixels, steps.natural()), pixels, strict=True):
        assert got == pytest.approx(want, abs=1e-5)


def test_blur_keeps_flat_images_and_sums(spark):
    flat = np.full((5, 6, 3), 0.4)
    chain = steps.gaussian_blur(sigma=1.2)
    blurred = lambda p: array(steps.apply(frame(spark, p), [*chain, ("result", f"SELECT * FROM {chain[-1][0]}")]))
    assert np.abs(blurred(flat) - flat).max() < 1e-12
    p = image(9, 8)
    k = np.exp(-(np.arange(-4, 5) ** 2) / (2 * 1.2**2))
    padded, ones = np.zeros((17, 16, 3)), np.zeros((17, 16, 1))
    padded[4:13, 4:12], ones[4:13, 4:12] = p, 1
    total = lambda a: sum(k[i] * k[j] * a[i : i + 9, j : j + 8] for i in range(9) for j in range(9))
    assert np.abs(blurred(p) - total(padded) / total(ones)).max() < 1e-12


def test_shift_is_found(spark):
    rows = registry.queries()["best_shift"](spark, SF).collect()
    assert {(r.dx, r.dy) for r in rows} == {(3, -2)} and all(r.mismatch == 0 for r in rows)


def test_scores_match_arrays(spark):
    r = np.random.default_rng(2)
    sides = {"ref": r.integers(0, 2, (2, 9, 70)), "cand": r.integers(0, 2, (2, 9, 70))}
    data = [(name, 0, y, x, int(a[0, y, x]), int(a[1, y, x])) for name, a in sides.items() for y in range(9) for x in range(70)]
    df = spark.createDataFrame(data, "side string, image_id long, y int, x int, bit int, mask int")
    chain = [*((s, f"SELECT image_id, y, x, bit, mask FROM pixels WHERE side = '{s}'") for s in sides), ("pairs", "SELECT 0L AS image_id, 0L AS ref_id, 30 AS cx, -1 AS cy"), *alignment.tiles("ref", "rt"), *alignment.tiles("cand", "ct"), *alignment.scores("rt", "ct", "pairs", "scores", 3), ("result", "SELECT dx, dy, mismatch, valid FROM scores")]
    found = {(x.dx, x.dy): (x.mismatch, x.valid) for x in steps.apply(df, chain).collect()}
    assert len(found) == 49
    for (dx, dy), got in found.items():
        both = [(sides["ref"][:, y, x], sides["cand"][:, y - dy, x - dx]) for y in range(9) for x in range(70) if 0 <= y - dy < 9 and 0 <= x - dx < 70]
        assert got == (sum((a[0] ^ b[0]) & a[1] & b[1] for a, b in both), sum(a[1] & b[1] for a, b in both))


def test_alignment_finds_known_transforms(spark):
    for r in registry.queries()["align_translation"](spark, SF).collect():
        assert (r.dx, r.dy, r.score) == (3 - r.image_id % 7, r.image_id % 11 - 5, 0)
    for r in registry.queries()["align_rotation"](spark, SF).collect():
        assert abs(r.angle - 1.5) <= 0.4 and abs(r.dx) <= 1 and abs(r.dy) <= 1
    assert all(abs(r.dx - 0.5) <= 0.25 and r.dy == 0 for r in registry.queries()["subpixel_refine"](spark, SF).collect())
    aligned = registry.queries()["align_pipeline"](spark, SF).toPandas()
    raster = registry.queries()["scan_raster"](spark, SF).toPandas()
    both = aligned.merge(raster, on=["image_id", "y", "x"])
    assert len(both) == len(raster) == len(aligned) and (both.r_x == both.r_y).all() and (both.b_x == both.b_y).all()


def test_alignment_through_more_levels(spark):
    r = np.random.default_rng(8)
    scene = np.kron(r.integers(20, 230, (60, 60)), np.ones((5, 5), int))
    ref, cand = scene[20:220, 20:276], scene[33:233, 9:265]  # reference (x, y) = candidate (x + 11, y - 13)
    rows = [(s, 0, y, x, int(a[y, x])) for s, a in (("ref", ref), ("cand", cand)) for y in range(200) for x in range(256)]
    df = spark.createDataFrame(rows, "side string, image_id long, y int, x int, v int")
    chain = [*((f"{s}_gray", f"SELECT image_id, y, x, v, 1 AS valid, 256 AS w, 200 AS h FROM pixels WHERE side = '{s}'") for s in ("ref", "cand")), *alignment.translation("ref_gray", "cand_gray", 256, 200), ("result", "SELECT dx, dy FROM translation")]
    assert alignment.sizes(256, 200) == [(256, 200), (128, 100), (64, 50)]
    assert [(x.dx, x.dy) for x in steps.apply(df, chain).collect()] == [(-11, 13)]


@pytest.mark.parametrize("fill", [None, "other"])
def test_resampling_of_solid_images(spark, fill):
    rows = [(s, 0, y, x, *c) for s, c in (("own", (180, 40, 20)), ("other", (15, 80, 160))) for y in range(8) for x in range(12)]
    df = spark.createDataFrame(rows, "side string, image_id long, y int, x int, r int, g int, b int")
    chain = [*((s, f"SELECT image_id, y, x, r, g, b FROM pixels WHERE side = '{s}'") for s in ("own", "other")), ("moves", "SELECT 0L AS image_id, 3.0e0 AS dx, 0.0e0 AS dy, 1.0e0 AS c, 0.0e0 AS s"), *alignment.resampled("own", "moves", 12, 8, fill), ("result", "SELECT * FROM resampled")]
    found = {(r.x, r.y): (r.r, r.g, r.b) for r in steps.apply(df, chain).collect()}
    assert len(found) == 96 and found[0, 2] == ((15, 80, 160) if fill else (0, 0, 0)) and found[6, 2] == (180, 40, 20)


def test_response_curve_and_pipeline(spark):
    rows = response.response_curves(spark, SF).toPandas()
    assert rows.groupby(["image_id", "channel"]).size().eq(256).all() and rows.groupby("image_id").channel.nunique().eq(3).all()
    for _, curve in rows.sort_values("z").groupby(["image_id", "channel"]):
        assert abs(curve.g.iloc[128]) < 1e-3 and curve.g.iloc[200] > curve.g.iloc[60] > curve.g.iloc[5]
    samples = registry.queries()["sample_lookup"](spark, SF).toPandas()
    one = samples[samples.image_id == 0].sort_values(["y", "x", "frame"])
    logs = np.log([1 / 60, 1 / 240, 1 / 15]) - 2 * np.log(8)
    normal, right = np.zeros((256, 256)), np.zeros(256)
    for z in one.g.to_numpy().reshape(-1, 3):
        w = response.hat(z) ** 2
        for i in range(3):
            normal[z[i], z[i]] += w[i]
            right[z[i]] += w[i] * logs[i] - w[i] * (w @ logs) / w.sum()
            for j in range(3):
                normal[z[i], z[j]] -= w[i] * w[j] / w.sum()
    expected = response.solve(normal, right)
    got = rows[(rows.image_id == 0) & (rows.channel == 1)].sort_values("z").g.to_numpy()
    assert np.abs(got - expected).max() < 1e-5
    out = response.hdr_pipeline(spark, SF)
    assert out.count() == registry.queries()["scan_raster"](spark, SF).count()
    assert out.selectExpr("min(least(r, g, b)) >= 0 AND max(greatest(r, g, b)) <= 255 AND stddev(r) > 5").first()[0]


def test_samples_are_filled_up(spark):
    masks = registry.queries()["motion_mask"](spark, SF).filter("m > 0.6").groupBy("image_id").count().collect()
    sizes = {r.image_id: r["count"] for r in registry.queries()["stratified_sample"](spark, SF).groupBy("image_id").count().collect()}
    assert sizes == {r.image_id: 500 for r in masks} and min(r["count"] for r in masks) > 2000


def test_settings_round_trip(tmp_path):
    preset = st.Filter("sky", "the sky", True, 24.0, (st.Range(200.0, 250.0, saturation_multiplier=-10.0), st.Range(saturation_multiplier=-20.0)))
    own = st.NaturalSettings(gamma=1.2, bypass_tone_compression_for_ldr=False, saturation_filters=(preset,), saturate_excludes=preset.ranges, post_process=st.Lab(contrast=1.1), white_balance_reference_type="Black", white_balance_reference_color=st.Color(0.1, 0.2, 0.3))
    assert st.from_xml(st.to_xml(own)) == own and all(st.from_xml(st.to_xml(k())) == k() for k in st.TYPES.values())
    assert [r[-1] for r in st.active_ranges((preset,))] == [24.0, 24.0]
    assert st.active_ranges((), (st.Range(), st.Range(saturation_multiplier=-20.0))) == [(0.0, 360.0, 0.0, 1.0, 0.0, 1.0, -20.0)]
    st.save_preset(str(tmp_path / "b.xml"), st.Filter(ranges=preset.ranges))
    st.save_preset(str(tmp_path / "a.xml"), preset)
    assert [f.name for f in st.load_presets(str(tmp_path))] == ["sky", "b"] and st.load_presets(None) == st.load_presets(" ") == []
    assert st.AcesSettings(transparent=3.0, local_contrast_radius=9).is_neutral() and not own.is_neutral()
    assert st.ContrastSettings(exposure_ev=1.0).core_neutral() and not st.ContrastSettings(luminance=1.1).core_neutral() and st.BrightnessSettings(strength=0.0, lighting=2.0).core_neutral()


def test_settings_files_of_other_shapes(tmp_path):
    head = '<?xml version="1.0" encoding="utf-8"?>\n'
    body = '<Settings xsi:type="AcesFilmicTonemapperSettings"><ExposureEV>0.5</ExposureEV><SaturateExcludes /><GrayColorFilter><Enabled>true</Enabled><Ranges><SaturationColorRange><HueMax>90</HueMax></SaturationColorRange></Ranges></GrayColorFilter><Key>0.2</Key></Settings>'
    model = f'{head}<ToneMapperSerializationModel xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">{body}</ToneMapperSerializationModel>'
    found = st.from_xml(model)
    assert found == st.AcesSettings(exposure_ev=0.5, key=0.2, gray_color_filter=st.Filter(enabled=True, ranges=(st.Range(hue_max=90.0),)))
    for wrong in (model.replace("ToneMapperSerializationModel", "Other"), model.replace("Key>", "Kee>"), model.replace("AcesFilmicTonemapperSettings", "NoSettings")):
        with pytest.raises(ValueError):
            st.from_xml(wrong)
    (tmp_path / "x.xml").write_text(model)
    with pytest.raises(ValueError):
        st.load_presets(str(tmp_path))


def test_stream(spark, tmp_path):
    from lumenspark.streaming import folder

    p, s = image(), st.AcesSettings(gamma=1.3, dehaze=30.0)
    frame(spark, p).write.parquet(str(tmp_path / "in"))
    folder.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), s).awaitTermination()
    assert np.abs(array(spark.read.parquet(str(tmp_path / "out"))) - brute.mapped(p, s, brute.aces)).max() < 1e-9


def test_series_cover_every_event(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    files = {}
    for i, kind, user in c.execute("SELECT event_id, event_type, user_id FROM events").fetchall():
        f, p = f"{i // 16:06}", i % 16
        name = {0: f"IMG{f}_over.jpg", 1: f"IMG{f}_UNDER.JPG", 2: f"img{f}.jpeg", 15: f"p{i:08}.txt"}.get(p, f"p{i:08}.png")
        bias = {"view": 0.0, "click": -2.0, "purchase": 2.0}.get(kind) if p > 2 else {0: 2.0, 1: -2.0, 2: 0.0}[p]
        if p != 15:
            files.setdefault(f, []).append((name, None if kind == "error" else bias, 32 if user % 2 else 64))
    series, singles, merged = [], [], []
    for f, listed in files.items():
        k, groups = 0, {}
        for name, bias, w in sorted(listed):
            if bias is not None:
                k += bias == 0
                groups.setdefault((k, w), []).append((name, bias))
        found = {key: m for key, m in groups.items() if len({b for _, b in m}) > 1}
        inside = {n for m in found.values() for n, _ in m}
        series += [(f, m[0][0], w, 50 if w == 32 else 100, len(m), len({b for _, b in m})) for (_, w), m in found.items()]
        alone = [(n, b, w) for n, b, w in listed if n not in inside]
        singles += [(f, n) for n, _, _ in alone]
        for n, b, w in alone:
            for (_, size), m in found.items():
                bases = {x.rsplit(".", 1)[0].lower().rpartition("_")[0] for x, _ in m if x.rsplit(".", 1)[0].lower().endswith(("_over", "_under"))}
                if b == 0 and w == size and bases == {n.rsplit(".", 1)[0].lower()} and all("_" in x for x, _ in m):
                    merged.append((f, m[0][0], n))
    q = registry.queries()
    assert sorted(tuple(r) for r in q["series_catalog"](spark, sf).select("folder", "first_path", "width", "height", "members", "biases").collect()) == sorted(series)
    assert sorted(tuple(r) for r in q["series_singles"](spark, sf).select("folder", "path").collect()) == sorted(singles)
    assert sorted(tuple(r) for r in q["series_merge_named"](spark, sf).select("folder", "first_path", "path").collect()) == sorted(merged) and merged


def test_bypass_threshold_is_by_image(spark):
    p = image(4, 5)
    base = dict(exposure_ev=0.2, contrast=1.1, saturation=20.0)
    mapped = lambda scale, **k: array(mapping.tone_map(frame(spark, p * scale), st.NaturalSettings(**base, **k)))
    core = dict(gamma=1.1)
    for scale, bypassed in ((1.0, False), (0.4, True)):
        limited = mapped(scale, ldr_bypass_white_point_threshold=0.5, **core)
        plain, compressed = mapped(scale, **core), mapped(scale, bypass_tone_compression_for_ldr=False, **core)
        assert np.abs(limited - (plain if bypassed else compressed)).max() < 1e-12 < 1e-3 < np.abs(plain - compressed).max()


@pytest.mark.parametrize("radius", [0, 1, 4, 100])
def test_box_mean_by_running_sums(spark, radius):
    p = image(9, 11)
    chain = steps.box_mean(radius=radius)
    got = steps.apply(frame(spark, p), [*chain, ("result", "SELECT y, x, mr AS r, mg AS g, mb AS b FROM box")])
    expected = np.array([[p[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].mean((0, 1)) for x in range(11)] for y in range(9)])
    assert np.abs(array(got) - expected).max() < 1e-12


def test_quantiles(spark):
    r = np.random.default_rng(12)
    images = {0: r.uniform(-3, 50, 997), 1: np.full(40, 2.5), 2: np.array([1.0]), 3: r.integers(0, 3, 300) / 2.0, 4: 0.5 + r.uniform(0, 1e-7, 500)}
    rows = spark.createDataFrame([(i, float(v)) for i, a in images.items() for v in a], "image_id long, v double")
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.98, "e": 1.0}
    for row in steps.apply(rows, [*steps.quantiles("pixels", "v", shares, "q"), ("result", "SELECT * FROM q")]).collect():
        assert [row[k] for k in shares] == pytest.approx(np.quantile(images[row.image_id], list(shares.values())), abs=1e-12)
