"""Image files, hashes and camera fields, on bitmaps written here."""

import struct

import numpy as np
from pyspark.sql import functions as F

from lumenlake.functions import images as I
from lumenlake.functions.hashes import hash_distance
from lumenlake.sources.images import read_image_files, read_pixels


def scene():
    rgb = np.full((384, 512, 3), 225, np.uint8)
    rgb[200:360, 60:220] = (150, 90, 60)
    rgb[80:160, 330:430] = (250, 220, 80)
    for k in range(160):
        rgb[200 - k, 220 + k // 2 : 300 - k // 4] = (60, 120, 70)
    return rgb


def bitmap(rgb):
    h, w = rgb.shape[:2]
    rows = [r[:, ::-1].tobytes() + b"\0" * (-3 * w % 4) for r in rgb[::-1]]
    body = b"".join(rows)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def jpeg_head(order="<"):
    def entry(tag, kind, count, value):
        return struct.pack(f"{order}HHI", tag, kind, count) + value

    long = lambda n: struct.pack(f"{order}I", n)
    inner_at, text_at = 8 + 2 + 36 + 4, 8 + 2 + 36 + 4 + 2 + 12 + 4
    first = struct.pack(f"{order}H", 3) + entry(271, 2, 3, b"Ab\0\0") + entry(274, 3, 1, struct.pack(f"{order}HH", 6, 0)) + entry(0x8769, 4, 1, long(inner_at)) + long(0)
    inner = struct.pack(f"{order}H", 1) + entry(36867, 2, 20, long(text_at)) + long(0)
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + long(8) + first + inner + b"2024:01:05 10:00:00\0"
    part = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    table = bytes([0]) + bytes([3688 // 64] * 64)
    return b"\xff\xd8" + part(0xE1, b"Exif\0\0" + tiff) + part(0xDB, table) + b"\xff\xda\0\2"


def test_files_pixels_and_hashes(spark, tmp_path):
    rgb = scene()
    small = np.clip(I.resized(rgb[:, :, 0].astype(float), 192, 256), 0, 255).astype(np.uint8)
    made = {"scene.bmp": rgb, "small.bmp": np.stack([np.clip(I.resized(rgb[:, :, c].astype(float), 192, 256), 0, 255).astype(np.uint8) for c in range(3)], axis=2), "bright.bmp": np.clip(rgb.astype(int) + 12, 0, 255).astype(np.uint8)}
    paper = np.full((384, 512, 3), 255, np.uint8)
    paper[100:110, 60:400], paper[200:210, 60:300] = 0, 0
    made["paper.bmp"] = paper
    for name, a in made.items():
        (tmp_path / name).write_bytes(bitmap(a))
    (tmp_path / "text.txt").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    assert small.shape == (192, 256)
    ok, bad = read_image_files(spark, str(tmp_path))
    assert sorted(r["filename"] for r in ok.collect()) == sorted(made)
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()} == {"text.txt": "unsupported"}
    assert read_image_files(spark, str(tmp_path), most=1000)[1].where("reason = 'too large'").count() == 4
    f = I.image_features(read_pixels(spark, str(tmp_path))[0]).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    rows = {r["name"]: r for r in f.collect()}
    a, b = f.where("name = 'scene.bmp'").select(F.col("phash").alias("p"), F.col("dhash").alias("d")), f
    far = {r["name"]: (r["p"], r["d"]) for r in b.crossJoin(a).select("name", hash_distance(F.col("phash"), F.col("p")).alias("p"), hash_distance(F.col("dhash"), F.col("d")).alias("d")).collect()}
    assert all(far[n][0] <= 10 and far[n][1] <= 12 for n in ("small.bmp", "bright.bmp")) and far["paper.bmp"][0] > 10
    assert rows["paper.bmp"]["flatness"] > 0.95 and (rows["scene.bmp"]["width"], rows["scene.bmp"]["height"]) == (512, 384)


def test_sharpness_falls_with_blur():
    rgb = scene()
    blurred = np.stack([I.resized(I.resized(rgb[:, :, c].astype(float), 48, 64), 384, 512, 0) for c in range(3)], axis=2).astype(np.uint8)
    assert I.features(rgb)[3] > 5 * I.features(blurred)[3]


def test_camera_fields(spark):
    df = spark.createDataFrame([(1, jpeg_head()), (2, jpeg_head(">")), (3, b"BM"), (4, b"\xff\xd8\xff\xe1\xff\xff"), (5, None)], "k int, content binary")
    got = {r["k"]: (r["taken_at"], r["camera"], r["jpeg_quality"], r["orientation"]) for r in I.with_camera_fields(df).collect()}
    assert got[1] == got[2] == ("2024-01-05T10:00:00", True, 50, 6)
    assert got[3] == got[4] == (None, False, None, 1) and got[5] == (None,) * 4


def test_upright_undoes_each_turn():
    a = np.arange(6).reshape(2, 3, 1).repeat(3, axis=2)
    assert I.upright(a, 6)[0, -1, 0] == 0 and I.upright(a, 8)[-1, 0, 0] == 0 and I.upright(a, 3)[-1, -1, 0] == 0 and I.upright(a, 2)[0, -1, 0] == 0
    assert I.upright(a, 5)[0, 0, 0] == 0 and I.upright(a, 5).shape[:2] == (3, 2) and I.upright(a, 7)[-1, -1, 0] == 0 and I.upright(a, 4)[-1, 0, 0] == 0


def test_crop_box_and_user_model(spark):
    one = spark.range(1).select(I.face_crop_box(*[F.lit(v) for v in (0.1, 0.5, 0.2, 0.5)], F.lit(100), F.lit(200)).alias("b")).first()["b"]
    assert tuple(one) == (4, 70, 36, 200)
    df = spark.createDataFrame([("a",), ("bbb",)], "t string")
    got = I.embed(df, lambda: lambda texts: [[float(len(t))] for t in texts], "t").collect()
    assert {r["t"]: r["embedding"] for r in got} == {"a": [1.0], "bbb": [3.0]}


def chunked(kind, tiff):
    """A PNG, WEBP or JPEG with this camera data and little else."""
    if kind == "png":
        part = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0" * 4
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", b"\0" * 13) + part(b"eXIf", tiff) + part(b"IEND", b"")
    part = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    body = b"WEBP" + part(b"VP8X", b"\0" * 4 + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")) + part(b"ODD ", b"x") + part(b"EXIF", (b"Exif\0\0" if kind == "webp" else b"") + tiff)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_camera_fields_of_every_kind(spark):
    tiff = next(b for m, b in I.segments(jpeg_head(">")) if m == 0xE1)[6:]
    rows = [("jpeg", jpeg_head("<")), ("png", chunked("png", tiff)), ("webp", chunked("webp", tiff)), ("bare", chunked("bare", tiff)), ("cut", chunked("png", tiff)[:60]), ("short", b"RIFF"), ("none", None), ("empty", b"")]
    got = {r["name"]: r for r in I.with_camera_fields(spark.createDataFrame(rows, "name string, content binary")).collect()}
    for kind in ("jpeg", "png", "webp", "bare"):
        assert (got[kind]["taken_at"], got[kind]["camera"], got[kind]["orientation"]) == ("2024-01-05T10:00:00", True, 6)
    assert got["jpeg"]["jpeg_quality"] is not None and got["png"]["jpeg_quality"] is None
    assert all(got[k]["taken_at"] is None and not got[k]["camera"] for k in ("cut", "short", "none", "empty"))


def test_every_file_is_in_one_of_both_tables(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(bitmap(scene()))
    (tmp_path / "broken.bmp").write_bytes(bitmap(scene())[:100])
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nrest")
    (tmp_path / "b.webp").write_bytes(chunked("webp", b"II*\0\0\0\0\0"))
    (tmp_path / "c.txt").write_bytes(b"no image")
    name = lambda r: r["path"].rsplit("/", 1)[1]
    ok, bad = read_pixels(spark, str(tmp_path))
    good, reasons = {name(r) for r in ok.collect()}, {name(r): (r["reason"], r["width"], r["height"]) for r in bad.collect()}
    assert good | set(reasons) == {"a.bmp", "broken.bmp", "broken.png", "b.webp", "c.txt"} and not good & set(reasons)
    assert "a.bmp" in good and reasons["b.webp"] == ("no decoder", 640, 480) and reasons["c.txt"][0] == "unsupported" and reasons["broken.png"][0] == "does not decode"
