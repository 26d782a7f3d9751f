"""Clips of recordings and running a detector over them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.functions.geometry import pixel_to_hz, pixel_to_seconds
from tonewright.operators.taxonomy import with_code
from tonewright.schema import BOX_FIELDS

CLIP_S, HOP_S, SEGMENT_S = 3.0, 1.5, 60.0


def clip_schedule(files: DataFrame, duration: str = "duration", clip: float = CLIP_S, hop: float = HOP_S) -> DataFrame:
    """Full windows only: a rest shorter than a window isn't covered, shorter files give none."""
    last = F.floor((F.col(duration) - clip) / hop)
    steps = F.when(F.col(duration) >= clip, F.sequence(F.lit(0).cast("long"), last))
    return (
        files.withColumn("clip_no", F.explode(steps))
        .withColumn("clip_start", F.col("clip_no") * F.lit(hop))
        .withColumn("clip_end", F.col("clip_start") + F.lit(clip))
        .withColumn("segment", F.floor(F.col("clip_start") / F.lit(SEGMENT_S)))
    )


class Detector(Protocol):
    """Finds boxes in clips. ``load`` runs once per task; pixels are those of a 256 x 256 image.

    ``configure`` is called before with the least confidence and the IoU above which the
    detector's own suppression drops a box; a detector without it keeps its own settings.
    """

    def configure(self, conf: float, nms_iou: float) -> None: ...

    def load(self) -> None: ...

    def boxes(self, clips: Iterable[dict]) -> Iterator[dict]:
        """Records with the columns of :data:`tonewright.schema.BOX_FIELDS`."""


def run_detector(clips: DataFrame, detector: Detector, conf: float | None = None, nms_iou: float | None = None) -> DataFrame:
    """Boxes of all clips; the detector is loaded once per task, with ``conf`` and ``nms_iou`` where given."""
    fields = [f.split()[0] for f in BOX_FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if hasattr(detector, "configure") and conf is not None and nms_iou is not None:
            detector.configure(conf, nms_iou)
        detector.load()
        for batch in batches:
            yield pd.DataFrame(list(detector.boxes(batch.to_dict("records"))), columns=fields)

    return clips.mapInPandas(run, BOX_FIELDS)


def boxes_to_detections(boxes: DataFrame, dim: DataFrame) -> DataFrame:
    """Detection rows of pixel boxes; the upper edge of a box is its high frequency."""
    named = with_code(boxes, dim)
    return named.select(
        "species", F.col("cls").alias("species_id"), F.col("conf").cast("double").alias("confidence"),
        pixel_to_seconds(F.col("x1"), F.col("clip_start")).cast("double").alias("time_start"),
        pixel_to_seconds(F.col("x2"), F.col("clip_start")).cast("double").alias("time_end"),
        pixel_to_hz(F.col("y2").cast("double")).alias("freq_low_hz"), pixel_to_hz(F.col("y1").cast("double")).alias("freq_high_hz"),
        "clip_start", "clip_end", "filename",
    )
