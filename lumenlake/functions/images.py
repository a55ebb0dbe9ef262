"""Features of images: hashes, sharpness, flatness, camera fields. Numpy on one image at a time inside Arrow batches.

Images are large: set spark.sql.execution.arrow.maxRecordsPerBatch (32, say) before running these.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sum of the standard luminance quantisation table at quality 50 (fixed value).
STANDARD_TABLE_SUM = 3688
#: Numbers of the EXIF fields used (fixed values).
MAKER, MODEL, ORIENTATION, DATE, EXIF_PART, TAKEN = 271, 272, 274, 306, 0x8769, 36867
COSINES = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(32) + 1) / 64)
FEATURES = "struct<phash:string,dhash:string,core_hash:string,sharpness:double,flatness:double>"
CAMERA = "struct<taken_at:string,camera:boolean,jpeg_quality:int,orientation:int>"


def weights(old: int, new: int, lobes: int) -> np.ndarray:
    """new x old resampling weights: Lanczos with `lobes` lobes, or a triangle (0), widened when shrinking."""
    scale = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new
    x = (np.arange(old)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0) if lobes else np.maximum(0.0, 1 - np.abs(x))
    return w / w.sum(axis=1, keepdims=True)


def resized(grey: np.ndarray, height: int, width: int, lobes: int = 3) -> np.ndarray:
    out = weights(grey.shape[0], height, lobes) @ grey @ weights(grey.shape[1], width, lobes).T
    return np.clip(np.rint(out), 0, 255)


def hexed(bits: np.ndarray) -> str:
    """Bit i of the flattened array is bit i of the number."""
    return np.packbits(bits.ravel(), bitorder="little")[::-1].tobytes().hex()


def perceptual_hash(grey: np.ndarray) -> str:
    low = COSINES @ resized(grey, 32, 32) @ COSINES.T
    return hexed(low > np.median(low))


def at_long_side(grey: np.ndarray, side: int) -> np.ndarray:
    """The picture with its long side at `side`, by triangle weights, three pixels a side at least."""
    shape = np.maximum(3, np.rint(np.array(grey.shape) * side / max(grey.shape)).astype(int))
    return resized(grey, *shape.tolist(), 0)


def curvature(grey: np.ndarray) -> float:
    """Variance of the second differences along both sides together, at the pixels that have all four neighbours."""
    return float((np.diff(grey, 2, axis=0)[:, 1:-1] + np.diff(grey, 2, axis=1)[1:-1]).var())


def sampled(rgb: np.ndarray, side: int) -> np.ndarray:
    """Every pixel, or those nearest to an even grid with `side` of them on the long side."""
    share = min(1.0, side / max(rgb.shape[:2]))
    for axis in (0, 1):
        n = rgb.shape[axis]
        kept = max(1, round(n * share))
        rgb = rgb.take(np.floor((np.arange(kept) + 0.5) * n / kept).astype(int), axis)
    return rgb


def unlike_neighbours(rgb: np.ndarray) -> float:
    """Share of neighbouring pixels that differ, the mean of both directions; none where there are no neighbours."""
    shares = []
    for axis in (0, 1):
        steps = np.diff(rgb.astype(np.int16), axis=axis).any(axis=2)
        shares.append(np.count_nonzero(steps) / max(1, steps.size))
    return sum(shares) / 2


def quality_of(table: np.ndarray) -> int:
    """Quality 1 to 100 of a luminance table: how its steps add up against those of the standard table.

    A sum of s percent of the standard one stands for quality (200 - s) / 2 up to 100 percent and 5000 / s above.
    """
    percent = 100 * float(table.sum()) / STANDARD_TABLE_SUM
    fine = percent <= 100
    return int(np.clip(np.rint(200 - percent) // 2 if fine else np.rint(5000 / percent), 1, 100))


def features(rgb: np.ndarray) -> tuple:
    """pHash, dHash, pHash of the middle three fifths, sharpness at a long side of 512, share of equal neighbours at 640."""
    h, w = rgb.shape[:2]
    grey = rgb.astype(float) @ np.array([0.299, 0.587, 0.114])
    small = resized(grey, 8, 9)
    flat = 1 - unlike_neighbours(sampled(rgb, 640))
    core = grey[int(h * 0.2) : max(int(h * 0.8), int(h * 0.2) + 1)]
    return perceptual_hash(grey), hexed(small[:, :-1] > small[:, 1:]), perceptual_hash(core), round(curvature(at_long_side(grey, 512)), 1), round(flat, 3)


def upright(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """Turned as the camera's orientation number says."""
    if orientation in (2, 4, 5, 7):
        rgb = rgb[:, ::-1]
    turns = {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)
    return np.rot90(rgb, turns)


def image_features(pixels: DataFrame) -> DataFrame:
    """path, width, height and the features of rows (path, width, height, channels, pixels[, orientation]); null where pixels are null or do not fit."""

    def run(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, turn: pd.Series) -> pd.DataFrame:
        rows = []
        for d, w, h, c, o in zip(data, width, height, channels, turn, strict=True):
            if d is None or not w or not h or len(d) != w * h * c:
                rows.append((None,) * 5)
                continue
            a = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c))
            rgb = a[:, :, 2::-1] if c >= 3 else np.repeat(a[:, :, :1], 3, axis=2)
            rows.append(features(upright(rgb, int(o))))
        return pd.DataFrame(rows, columns=["phash", "dhash", "core_hash", "sharpness", "flatness"])

    turn = F.coalesce("orientation", F.lit(1)) if "orientation" in pixels.columns else F.lit(1)
    side = turn >= 5
    made = pixels.withColumn("_f", F.pandas_udf(run, FEATURES)("pixels", "width", "height", "channels", turn))
    return made.select("path", F.when(side, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(side, F.col("width")).otherwise(F.col("height")).alias("height"), "_f.*")


def segments(content: bytes):
    """(marker, payload) of a JPEG's segments before the picture data."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        yield content[at + 1], content[at + 4 : at + 2 + size]
        at += 2 + max(size, 2)


def exif_entries(data: bytes, order: str, at: int) -> dict[int, object]:
    """Text and short fields of one directory; what does not fit the data is left out."""
    out: dict[int, object] = {}
    if at + 2 > len(data):
        return out
    (n,) = struct.unpack_from(f"{order}H", data, at)
    for k in range(n):
        place = at + 2 + 12 * k
        if place + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, place)
        if kind == 2:
            start = place + 8 if count <= 4 else struct.unpack_from(f"{order}I", data, place + 8)[0]
            out[tag] = data[start : start + count].split(b"\0")[0].decode("ascii", "replace").strip()
        elif kind in (3, 4):
            out[tag] = struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", data, place + 8)[0]
    return out


def png_chunks(content: bytes):
    """(kind, body) of a PNG's chunks, as far as they are whole."""
    at = 8
    while at + 12 <= len(content):
        (size,) = struct.unpack_from(">I", content, at)
        if at + 12 + size > len(content):
            return
        yield content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        at += 12 + size


def riff_chunks(content: bytes):
    """(kind, body) of a WEBP's chunks, as far as they are whole; bodies of odd length are padded."""
    at = 12
    while at + 8 <= len(content):
        (size,) = struct.unpack_from("<I", content, at + 4)
        if at + 8 + size > len(content):
            return
        yield content[at : at + 4], content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def exif_block(content: bytes) -> bytes:
    """The camera data of a JPEG, PNG or WEBP, from its byte order on; empty where there is none."""
    found = b""
    if content[:2] == b"\xff\xd8":
        found = next((body for marker, body in segments(content) if marker == 0xE1 and body[:6] == b"Exif\0\0"), b"")
    elif content[:8] == b"\x89PNG\r\n\x1a\n":
        found = next((body for kind, body in png_chunks(content) if kind == b"eXIf"), b"")
    elif content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        found = next((body for kind, body in riff_chunks(content) if kind == b"EXIF"), b"")
    found = found.removeprefix(b"Exif\0\0")
    return found if found[:2] in (b"II", b"MM") and len(found) >= 8 else b""


def webp_size(content: bytes) -> tuple[int, int] | None:
    """Width and height of a WEBP by the header of its first picture chunk; None for other files and broken ones."""
    if content[:4] != b"RIFF" or content[8:12] != b"WEBP":
        return None
    for kind, body in riff_chunks(content):
        if kind == b"VP8X" and len(body) >= 10:
            return 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
        if kind == b"VP8L" and len(body) >= 5 and body[0] == 0x2F:
            bits = int.from_bytes(body[1:5], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 " and len(body) >= 10 and body[3:6] == b"\x9d\x01\x2a":
            return int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF
    return None


def camera_fields(content: bytes) -> tuple:
    """taken_at, camera, orientation of a JPEG, PNG or WEBP and the quality of a JPEG; other kinds have none."""
    fields: dict[int, object] = {}
    inner: dict[int, object] = {}
    quality = None
    if data := exif_block(content):
        order = "<" if data[:2] == b"II" else ">"
        fields = exif_entries(data, order, struct.unpack_from(f"{order}I", data, 4)[0])
        if isinstance(fields.get(EXIF_PART), int):
            inner = exif_entries(data, order, fields[EXIF_PART])
    for marker, body in segments(content) if content[:2] == b"\xff\xd8" else ():
        while marker == 0xDB and body:
            size = 128 if body[0] >> 4 else 64
            table = np.frombuffer(body[1 : 1 + size], ">u2" if size == 128 else "u1")
            if body[0] & 15 == 0 and len(table) == 64:
                quality = quality_of(table)
            body = body[1 + size :]
    said = str(inner.get(TAKEN) or fields.get(DATE) or "").split(" ")
    taken = f"{said[0].replace(':', '-')}T{said[1]}" if len(said) == 2 else None
    turn = fields.get(ORIENTATION)
    return taken, bool(fields.get(MAKER) or fields.get(MODEL) or inner.get(TAKEN)), quality, turn if turn in range(1, 9) else 1


def with_camera_fields(files: DataFrame, content: str = "content") -> DataFrame:
    """files with taken_at, camera, jpeg_quality, orientation; null content gives nulls."""

    def run(parts: pd.Series) -> pd.DataFrame:
        rows = [camera_fields(bytes(p)) if p is not None else (None,) * 4 for p in parts]
        return pd.DataFrame(rows, columns=["taken_at", "camera", "jpeg_quality", "orientation"]).astype({"jpeg_quality": "Int32", "orientation": "Int32"})

    return files.withColumn("_c", F.pandas_udf(run, CAMERA)(F.col(content))).select("*", "_c.*").drop("_c")


def face_crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, margin: float = 0.3) -> Column:
    """left, top, right, bottom in pixels: the box and a margin, within the photo."""
    return F.struct(
        F.greatest(F.lit(0), ((x - w * margin) * width).cast("int")).alias("left"),
        F.greatest(F.lit(0), ((y - h * margin) * height).cast("int")).alias("top"),
        F.least(width.cast("int"), ((x + w * (1 + margin)) * width).cast("int")).alias("right"),
        F.least(height.cast("int"), ((y + h * (1 + margin)) * height).cast("int")).alias("bottom"),
    )


def embed(df: DataFrame, load, col: str, to: str = "embedding") -> DataFrame:
    """df with the vector that a user's model gives: load() runs once a task and returns f(list of values) -> list of vectors."""
    schema = df.select("*", F.lit(None).cast("array<float>").alias(to)).schema

    def run(frames):
        model = load()
        for f in frames:
            yield f.assign(**{to: list(model(f[col].to_list()))})

    return df.mapInPandas(run, schema)
