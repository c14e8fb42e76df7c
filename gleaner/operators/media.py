"""Framing of JPEG buffers, flat bands of decoded images, and the best buffer per image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import constants as K
from ..functions import urls as U
from ..functions.text import col


def jpeg_frame(data: Column | str) -> Column:
    """Where a JPEG begins and ends (size, starts, end_at, state, valid, strict); an end marker counts within the last 64 KiB."""
    raw = F.coalesce(col(data), F.lit(b""))
    size = F.octet_length(raw).cast("long")
    part = lambda start, n: F.substring(raw, start, n)
    head, begin, end = part(F.lit(1), F.lit(2)), F.lit(b"\xff\xd8"), F.lit(b"\xff\xd9")
    starts = (size > 3) & (head == begin)
    # One character for each byte of the tail; the last marker is the first one from behind.
    before = F.greatest(size - K.JPEG_TAIL, F.lit(0))
    tail = F.decode(part((before + 1).cast("int"), F.lit(K.JPEG_TAIL)), "ISO-8859-1")
    back = F.locate("\xd9\xff", F.reverse(tail))
    at = F.when(back > 0, size - back - 1).otherwise(F.lit(-1)).cast("long")
    trailing = size - at - 2
    state = (
        F.when(size == 0, "empty")
        .when(~starts, "not a jpeg")
        .when(at < 0, "truncated (no EOI)")
        .when(size <= K.MIN_JPEG_BYTES, F.concat(F.lit("too small ("), size, F.lit("b)")))
        .when(trailing > 0, F.concat(F.lit("ok ("), trailing, F.lit("b trailing after EOI)")))
        .otherwise("ok")
    )
    strict = (head == begin) & (part(F.greatest(size - 1, F.lit(1)).cast("int"), F.lit(2)) == end)
    valid = (size > K.MIN_JPEG_BYTES) & starts & (at > 0)
    return F.struct(size.alias("size"), starts.alias("starts"), at.alias("end_at"), state.alias("state"), valid.alias("valid"), strict.alias("strict"))


def flat_bands(width: Column, height: Column, rgb: Column, cfg: dict = K.GREY_BANDS) -> Column:
    """How many of the lower strips are the flat grey of a decoder's fill, for pixels as an array of r, g, b."""

    def band(i: int) -> Column:
        top = F.floor(height * (cfg["height_start"] + cfg["height_span"] * i / cfg["bands"])).cast("int")
        rows = F.least(height - top, F.lit(cfg["strip_px"]))
        pixels = F.slice(rgb, top * width * 3 + 1, rows * width * 3)
        n = (rows * width).cast("double")

        def channel(c: int) -> tuple[Column, Column]:
            own = F.filter(pixels, lambda _, j: j % 3 == c)
            total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
            square = F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x)
            return total / n, square / n - F.pow(total / n, 2)

        stats = [channel(c) for c in range(3)]
        on_level = F.lit(True)
        for mean, _ in stats:
            on_level = on_level & (F.abs(mean - cfg["target_level"]) < cfg["mean_tolerance"])
        return (on_level & (stats[0][1] + stats[1][1] + stats[2][1] < cfg["variance_max"])).cast("int")

    total = band(0)
    for i in range(1, cfg["bands"]):
        total = total + band(i)
    return total


@F.pandas_udf(LongType())
def _flat_strips(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    cfg = K.GREY_BANDS

    def one(raw: bytes, rows: int, columns: int, deep: int) -> int:
        pixels = np.frombuffer(raw, np.uint8).reshape(rows, columns, deep)[:, :, :3]
        flat = 0
        for i in range(cfg["bands"]):
            top = int(rows * (cfg["height_start"] + cfg["height_span"] * i / cfg["bands"]))
            strip = pixels[top : top + cfg["strip_px"]].reshape(-1, pixels.shape[2]).astype(np.float64)
            level = np.abs(strip.mean(axis=0) - cfg["target_level"]) < cfg["mean_tolerance"]
            flat += bool(level.all() and strip.var(axis=0).sum() < cfg["variance_max"])
        return flat

    given = zip(data, height, width, channels, strict=True)
    return pd.Series([None if raw is None else one(raw, int(h), int(w), int(c)) for raw, h, w, c in given], dtype="Int64")


def inspect_images(images: DataFrame) -> DataFrame:
    """(path, bad, reason, flat) of decoded images (path, height, width, channels, data).

    An image is bad if so many of its lower strips are the flat grey of a decoder's fill, or if it
    couldn't be decoded at all (no data).
    """
    cfg = K.GREY_BANDS
    seen = images.select("path", _flat_strips("data", "height", "width", "channels").alias("flat"))
    filled = F.col("flat") >= cfg["min_bad_bands"]
    reason = F.when(F.col("flat").isNull(), "undecodable").when(filled, F.concat("flat", F.lit(f"/{cfg['bands']} lower bands are decoder fill grey"))).otherwise("ok")
    return seen.select("path", F.coalesce(filled, F.lit(True)).alias("bad"), reason.alias("reason"), "flat")


def largest_media(responses: DataFrame, pattern: str, valid: Column) -> DataFrame:
    """(media_id, seq, size): per image the largest valid buffer, of equals the first; avatars are left out."""
    rows = responses.withColumn("media_id", U.media_id("url", pattern)).where(F.col("media_id").isNotNull() & ~U.is_avatar("url") & valid)
    best = rows.groupBy("media_id").agg(F.max(F.struct("size", (-F.col("seq")).alias("back"))).alias("b"))
    return best.select("media_id", (-F.col("b.back")).alias("seq"), F.col("b.size").alias("size"))


def recorded_requests(requests: DataFrame, limit: int = K.URL_LIMIT) -> DataFrame:
    """The distinct addresses of a request log, cut to ``limit``, without assets and third parties."""
    kept = requests.where(~U.is_asset("url") & ~U.is_third_party("url"))
    return kept.select(F.substring("url", 1, limit).alias("url")).distinct()


def api_bodies(responses: DataFrame, pattern: str = "/api/", limit: int = K.BODY_LIMIT) -> DataFrame:
    kept = responses.where(F.col("url").rlike(pattern) & ~U.is_asset("url"))
    return kept.withColumn("body", F.substring("body", 1, limit))
