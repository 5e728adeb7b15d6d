"""Source tables as named SELECTs: rasters from embeddings, exposure brackets, and an image catalog from events."""

from __future__ import annotations

from ..functions.dialect import n


def _byte(e: str) -> str:
    return f"cast(greatest(0.0e0, least(255.0e0, floor(cast({e} AS double) * {n(212.5)} + {n(127.5)}))) AS int)"


def table(name: str, spark: bool, sf_dir: str) -> str:
    return f"parquet.`{sf_dir}/{name}.parquet`" if spark else name


def series(column: str, low: int, high: int, spark: bool) -> str:
    return f"SELECT cast(id AS int) AS {column} FROM range({low}, {high + 1})" if spark else f"SELECT cast(range AS int) AS {column} FROM range({low}, {high + 1})"


#: Bracket frames (exposure value, exposure time); f-number 8, ISO 100.
FRAMES = ((0, 0.0, 1 / 60), (1, -2.0, 1 / 240), (2, 2.0, 1 / 15))


def fixtures(spark: bool, sf_dir: str) -> dict[str, tuple[list[str], str]]:
    """name: (the names it reads, SELECT)."""
    at = (lambda k: f"embedding[(x + {k}) % 64]") if spark else (lambda k: f"embedding[((x + {k}) % 64) + 1]")
    xs = "explode(sequence(0, 63))" if spark else "cast(unnest(range(0, 64)) AS int)"
    inner = f"SELECT vec_id, embedding, {xs} AS x FROM {table('embeddings', spark, sf_dir)}"
    logs = " ".join(f"WHEN {f} THEN ln({n(t)}) - 2.0e0 * ln(8.0e0)" for f, _, t in FRAMES)
    scale = " ".join(f"WHEN {f} THEN {n(2.0**ev)}" for f, ev, _ in FRAMES)
    moved = "frame = 1 AND x BETWEEN 20 AND 27 AND y BETWEEN 30 AND 49"
    # a dark scene, so that the bright frame is clipped in highlights only
    scene = lambda c: f"(3 * {c} DIV 8)"
    byte = lambda c: f"cast(CASE WHEN {moved} THEN 255 - {scene(c)} ELSE least(255, floor({scene(c)} * (CASE frame {scale} END))) END AS int)"
    around = lambda line, order: f"OVER (PARTITION BY image_id, {line} ORDER BY {order} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    kind = "CASE event_type WHEN 'view' THEN 0.0e0 WHEN 'click' THEN -2.0e0 WHEN 'purchase' THEN 2.0e0 END"
    folder, number = "lpad(cast(event_id DIV 16 AS string), 6, '0')", "lpad(cast(event_id AS string), 8, '0')"
    return {
        "raster": ([], f"SELECT vec_id DIV 100 AS image_id, cast(vec_id % 100 AS int) AS y, x, {_byte(at(0))} AS r, {_byte(at(21))} AS g, {_byte(at(42))} AS b FROM ({inner}) e"),
        "unit": (["raster"], "SELECT image_id, y, x, r / 255.0e0 AS r, g / 255.0e0 AS g, b / 255.0e0 AS b FROM raster"),
        "hdr": (["raster"], "SELECT image_id, y, x, exp(4.0e0 * (r / 255.0e0) - 2.0e0) AS r, exp(4.0e0 * (g / 255.0e0) - 2.0e0) AS g, exp(4.0e0 * (b / 255.0e0) - 2.0e0) AS b FROM raster"),
        "frame": ([], series("frame", 0, 2, spark)),
        "bracket": (["raster", "frame"], f"SELECT image_id, frame, y, x, {byte('r')} AS r, {byte('g')} AS g, {byte('b')} AS b, CASE frame {logs} END AS loge FROM raster CROSS JOIN frame"),
        "gray": (["raster"], "SELECT image_id, y, x, (54 * r + 183 * g + 19 * b) DIV 256 AS v, CASE WHEN (x + y) % 7 = 0 THEN 0 ELSE 1 END AS valid, 64 AS w, 100 AS h FROM raster"),
        "level": ([], series("z", 0, 255, spark)),
        "response": (["level"], "SELECT z, ln((z + 0.5e0) / 128.5e0) AS g, exp(-((z - 128) / 96.0e0) * ((z - 128) / 96.0e0)) AS w FROM level"),
        # means of seven by seven pixels of the raster, with more contrast
        "soft_lines": (["raster"], f"SELECT image_id, y, x, sum((54 * r + 183 * g + 19 * b) DIV 256) {around('y', 'x')} AS s, count(*) {around('y', 'x')} AS n FROM raster"),
        "soft": (["soft_lines"], f"SELECT image_id, y, x, sum(s) {around('x', 'y')} AS s, sum(n) {around('x', 'y')} AS n FROM soft_lines"),
        "smooth": (["soft"], "SELECT image_id, y, x, cast(greatest(0, least(255, 128 + ((s - 128 * n) * 5) DIV n)) AS int) AS v, 1 AS valid, 64 AS w, 100 AS h FROM soft"),
        "catalog": ([], f"SELECT {folder} AS folder, CASE event_id % 16 WHEN 0 THEN concat('IMG', {folder}, '_over.jpg') WHEN 1 THEN concat('IMG', {folder}, '_UNDER.JPG') WHEN 2 THEN concat('img', {folder}, '.jpeg') WHEN 15 THEN concat('p', {number}, '.txt') ELSE concat('p', {number}, '.png') END AS path, CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 16 = 0 THEN 2.0e0 WHEN event_id % 16 = 1 THEN -2.0e0 WHEN event_id % 16 = 2 THEN 0.0e0 ELSE {kind} END AS bias, CASE WHEN user_id % 2 = 0 THEN 64 ELSE 32 END AS width, CASE WHEN user_id % 2 = 0 THEN 100 ELSE 50 END AS height FROM {table('events', spark, sf_dir)}"),
        "exif": ([], f"SELECT event_id AS frame_id, CASE WHEN event_type = 'error' THEN NULL ELSE 1.0e0 / (1 + user_id % 250) END AS exposure_time, CASE WHEN event_type = 'signup' THEN NULL ELSE 2.0e0 + (user_id % 9) END AS f_number, CASE WHEN event_type = 'click' THEN NULL ELSE 100.0e0 * (1 + event_id % 4) END AS iso, cast(event_id % 9 AS double) AS shutter_speed_value, cast(event_id % 7 AS double) AS aperture_value, CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 5 - 2.0e0 END AS bias, CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('maker ', cast(user_id % 3 AS string)) END AS make, concat('model ', cast(user_id % 4 AS string)) AS model FROM {table('events', spark, sf_dir)}"),
    }


def closure(names: list[str], known: dict[str, tuple[list[str], str]]) -> list[tuple[str, str]]:
    """The named fixtures and those they read, in order."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in out:
            for need in known[name][0]:
                add(need)
            out[name] = known[name][1]

    for name in names:
        add(name)
    return list(out.items())
