"""Image files: metadata, decoding, encoding, and the batch from a folder of brackets and single images."""

import struct
import zlib
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from lumenspark import batch
from lumenspark.sources import image_files, images
from lumenspark.sources import settings as st


def exif(order="<", **tags):
    """A metadata block with a directory and a sub-directory."""
    ids = {v: k for k, v in images.TAGS.items()}
    main, sub = [k for k in tags if k in images.TEXTS], [k for k in tags if k not in images.TEXTS]
    at = 8
    after = at + 2 + 12 * (len(main) + 1) + 4
    tail = after + 2 + 12 * len(sub) + 4
    extra = b""

    def entry(name):
        nonlocal extra
        v = tags[name]
        if isinstance(v, str):
            data, kind, n = v.encode() + b"\0", 2, len(v) + 1
        elif isinstance(v, int):
            return struct.pack(f"{order}HHI", ids[name], 3, 1) + struct.pack(f"{order}H", v) + b"\0\0"
        else:
            data, kind, n = struct.pack(f"{order}ii", *v), 10, 1
        if len(data) <= 4:
            return struct.pack(f"{order}HHI", ids[name], kind, n) + data.ljust(4, b"\0")
        place = tail + len(extra)
        extra += data
        return struct.pack(f"{order}HHII", ids[name], kind, n, place)

    first = struct.pack(f"{order}H", len(main) + 1) + b"".join(map(entry, main)) + struct.pack(f"{order}HHII", images.SUB_DIRECTORY, 4, 1, after) + b"\0" * 4
    second = struct.pack(f"{order}H", len(sub)) + b"".join(map(entry, sub)) + b"\0" * 4
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", at) + first + second + extra


def png(image, block=None):
    return images.encoded((line.astype(np.uint8).tobytes() for line in image), image.shape[1], image.shape[0], block)


def filtered(image, kind):
    """The same image with lines told as differences."""
    h, w, _ = image.shape
    lines, above = [], np.zeros(w * 3, int)
    for y in range(h):
        now = image[y].astype(int).ravel()
        left, corner = np.concatenate([[0] * 3, now[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        near = [min(((abs(a + b - c - v), k) for k, v in enumerate((a, b, c))))[1] for a, b, c in zip(left, above, corner, strict=True)]
        own = kind if isinstance(kind, int) else kind[y]
        guess = {0: 0 * left, 1: left, 2: above, 3: (left + above) // 2, 4: np.choose(near, [left, above, corner])}[own]
        lines.append(bytes([own]) + ((now - guess) % 256).astype(np.uint8).tobytes())
        above = now
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("order", ["<", ">"])
def test_metadata(order):
    block = exif(order, make="Maker of things", model="M1", exposure_time=(1, 60), f_number=(8, 1), iso=200, bias=(-2, 1), aperture_value=(3, 0))
    assert images.exif_values(block) == {"make": "Maker of things", "model": "M1", "exposure_time": 1 / 60, "f_number": 8.0, "iso": 200.0, "bias": -2.0}
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xc0" + struct.pack(">HBHHB", 9, 8, 30, 40, 1) + b"\0\0" + b"\xff\xda\0\2"
    assert images.described(jpeg) == (40, 30, block)
    for n in range(len(block)):  # cut short anywhere
        images.exif_values(block[:n])
    assert images.described(b"") == (None, None, None) and images.exif_values(b"") == {}


def test_decoding():
    image = np.random.default_rng(1).integers(0, 256, (9, 7, 3))
    assert (images.decoded(png(image)) == image).all()
    for kind in (1, 2, 3, 4):
        assert (images.decoded(filtered(image, kind)) == image).all()


def test_batch(spark, tmp_path):
    r = np.random.default_rng(5)
    scene = np.clip(np.linspace(2, 60, 40 * 30).reshape(40, 30, 1) + r.integers(0, 4, (40, 30, 3)), 0, 63).astype(int)
    times = {0: (1, 60), -2: (1, 240), 2: (1, 15)}
    source = tmp_path / "in"
    (source / "deeper").mkdir(parents=True)
    blocks = {}
    for folder in (source, source / "deeper"):
        for name, bias in (("a1.png", 0), ("a2.PNG", -2), ("a3.png", 2)):
            blocks[bias] = exif(make="m", exposure_time=times[bias], f_number=(8, 1), iso=100, bias=(bias, 1))
            (folder / name).write_bytes(png(np.floor(scene * 2.0**bias), blocks[bias]))
    for name, bias in (("B_over.png", 2), ("B_under.png", -2), ("b.png", 0)):
        (source / "deeper" / name).write_bytes(png(np.floor(scene[:20] * 2.0**bias), exif(exposure_time=times[bias], f_number=(8, 1), iso=100, bias=(bias, 1))))
    single = r.integers(0, 256, (11, 5, 3))
    (source / "single.png").write_bytes(png(single, blocks[2]))
    (source / "plain.png").write_bytes(png(single))
    (source / "notes.txt").write_text("no image")
    _, frames = batch.cataloged(spark, str(source))
    assert frames.count() == 11 and {(f.path, f.bias) for f in frames.collect() if f.make == "m" and f.width == 5} == {("single.png", 2.0)}
    members, singles = batch.series_of(frames)
    found = {}
    for m in members.collect():
        found.setdefault(m.series.rpartition("/in/")[2], {})[m.frame] = m.path
    assert found == {"a1.png": {0: "a1.png", 1: "a2.PNG", 2: "a3.png"}, "deeper/a1.png": {0: "a1.png", 1: "a2.PNG", 2: "a3.png"}, "deeper/B_over.png": {0: "b.png", 1: "B_over.png", 2: "B_under.png"}}
    assert {s.path for s in singles.collect()} == {"single.png", "plain.png"}
    batch.process(spark, str(source), str(tmp_path / "out"), st.NaturalSettings(), samples=300, align=False)
    merged, single_names = (sorted(f.name for f in (tmp_path / "out" / x).iterdir()) for x in ("Hdr", "Single"))
    assert len(merged) == 3 and len(single_names) == 2
    for name in single_names:  # neutral settings
        data = (tmp_path / "out" / "Single" / name).read_bytes()
        assert (images.decoded(data) == single).all() and images.described(data)[2] == (blocks[2] if name.startswith("single") else None)
    for name in merged:
        data = (tmp_path / "out" / "Hdr" / name).read_bytes()
        image = images.decoded(data)
        assert image.shape[1:] == (30, 3) and image[-5:].mean() > image[:5].mean() and images.exif_values(images.described(data)[2])["exposure_time"] == 1 / 60


def test_batch_aligns_brackets(spark, tmp_path):
    """A bracket of moved frames gives the file of the one that was held still; nothing is taken for motion."""
    r = np.random.default_rng(3)
    scene = np.kron(r.integers(4, 60, (28, 32, 3)), np.ones((4, 4, 1), int))
    place = {0: (8, 8), -2: (8, 8), 2: (11, 6)}
    for name, moved in (("still", False), ("moved", True)):
        folder = tmp_path / name
        folder.mkdir()
        for k, bias in enumerate((0, -1, 2)):
            y, x = place[bias] if moved and bias in place else (8, 8)
            block = exif(exposure_time=(100, int(6000 / 2.0**bias)), f_number=(8, 1), iso=100, bias=(bias, 1))
            (folder / f"a{k}.png").write_bytes(png(np.minimum(255, np.floor(scene[y : y + 96, x : x + 112] * 2.0**bias)), block))
        for align in (True, False):
            batch.process(spark, str(folder), str(tmp_path / f"{name}-{align}"), st.NaturalSettings(), samples=300, motion=0.0, align=align)
    read = {k: images.decoded(next((tmp_path / k / "Hdr").iterdir()).read_bytes()).astype(int)[8:-8, 8:-8] for k in ("still-False", "moved-True", "moved-False")}
    assert np.abs(read["moved-True"] - read["still-False"]).mean() <= 2 < np.abs(read["moved-False"] - read["still-False"]).mean()


def test_image_source(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 256, (6, 4, 3))
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a.png", "B.PNG", "sub/c.png", "d.txt", "_e.png"):
        (tmp_path / "in" / name).write_bytes(png(image))
    read = image_files.registered(spark).read.format("images")
    assert {r.path.rpartition("/in/")[2]: (r.width, r.height) for r in read.load(str(tmp_path / "in")).collect()} == dict.fromkeys(("a.png", "B.PNG", "sub/c.png"), (4, 6))
    assert read.option("rows", "pixels").load(f"file://{tmp_path}/in").groupBy("path").count().filter("count = 24").count() == 3
    assert [r.path.rpartition("/")[2] for r in spark.read.format("images").load(str(tmp_path / "in")).filter("path LIKE '%c.png'").collect()] == ["c.png"]
    reader = image_files.ImageReader({"path": str(tmp_path / "in")})
    assert not list(reader.pushFilters([image_files.StringEndsWith(("path",), "c.png")])) and sum(len(p.paths) for p in reader.partitions()) == 1
    rows = spark.createDataFrame([(f"{i}.png", png(image)) for i in range(5)], "name string, content binary").repartition(3)
    rows.write.format("images").mode("append").save(str(tmp_path / "out"))
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == [f"{i}.png" for i in range(5)]
    with pytest.raises(Exception, match="no name of a file"):
        rows.unionAll(spark.createDataFrame([("x/y.png", b"")], rows.schema)).write.format("images").mode("append").save(str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.png")) and spark.read.format("images").load(str(tmp_path / "bad")).count() == 0
    # two attempts of one task, of which one counts
    writer = image_files.ImageWriter({"path": str(tmp_path / "twice")})
    batches = [pa.RecordBatch.from_pydict({"name": ["x.png"], "content": [png(image)]})]
    done = []
    for attempt in (7, 8):
        with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 0, taskAttemptId=lambda a=attempt: a)):
            done.append(writer.write(iter(batches)))
    writer.commit(done[1:])
    assert [f.name for f in (tmp_path / "twice").iterdir()] == ["x.png"]


def test_diagonals_decode_large_lines():
    image = np.random.default_rng(1).integers(0, 256, (40, 63, 3))
    kinds = [k % 5 for k in range(40)]
    assert (images.decoded(filtered(image, kinds)) == image).all()
