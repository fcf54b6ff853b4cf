"""Column expressions over landmark lists and embeddings (P5-P8, distances)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the face feature: weights of appearance and position, landmark numbers of the inner lips.
APPEARANCE_WEIGHT = 0.35
POSITION_WEIGHT = 2.5
UPPER_LIP, LOWER_LIP = 13, 14
BOX_PADDING_PX = 10
NORM_FLOOR = 1e-8


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def landmark_embedding(points: Column) -> Column:
    """P5: landmark coordinates in one flat list."""
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"], p["z"])))


def lip_openness(points: Column) -> Column:
    """Vertical distance between the inner lip landmarks."""
    return F.abs(F.get(points, F.lit(UPPER_LIP))["y"] - F.get(points, F.lit(LOWER_LIP))["y"]).cast("double")


def bounding_box(points: Column, width: Column, height: Column) -> Column:
    """Pixel box around the landmarks, padded and kept inside the frame."""

    def low(axis: str, size: Column) -> Column:
        edge = F.array_min(F.transform(points, lambda p: p[axis].cast("double") * size)).cast("int") - BOX_PADDING_PX
        return F.greatest(edge, F.lit(0))

    def high(axis: str, size: Column) -> Column:
        edge = F.array_max(F.transform(points, lambda p: p[axis].cast("double") * size)).cast("int") + BOX_PADDING_PX
        return F.least(edge, size - 1)

    return F.struct(
        low("x", width).alias("x1"), low("y", height).alias("y1"),
        high("x", width).alias("x2"), high("y", height).alias("y2"),
    )


def norm(vector: Column) -> Column:
    return F.sqrt(_total(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def cluster_feature(embedding: Column, bbox: Column, frame_width: Column, frame_height: Column) -> Column:
    """Unit embedding next to box centre and width, as fractions of the main clip's frame."""
    width = F.greatest(frame_width.cast("double"), F.lit(1.0))
    height = F.greatest(frame_height.cast("double"), F.lit(1.0))
    scale = F.lit(APPEARANCE_WEIGHT) / (norm(embedding) + NORM_FLOOR)
    appearance = F.zip_with(
        embedding, F.array_repeat(scale, F.size(embedding)), lambda x, s: x.cast("double") * s
    )
    position = F.array(
        (bbox["x1"] + bbox["x2"]) / 2 / width * POSITION_WEIGHT,
        (bbox["y1"] + bbox["y2"]) / 2 / height * POSITION_WEIGHT,
        (bbox["x2"] - bbox["x1"]) / width * POSITION_WEIGHT,
    )
    return F.concat(appearance, position)


def face_score(bbox: Column, lip: Column) -> Column:
    """Lip movement and box area in one number; bigger means more likely the speaker."""
    area = (bbox["x2"] - bbox["x1"]).cast("double") * (bbox["y2"] - bbox["y1"])
    return lip * 1000.0 + area
