"""What may be plugged in: detectors and recognisers as functions from table to table, which Spark runs over Arrow batches.

An implementation takes the rows that its protocol names and gives back one row per finding. ``readers.pixels`` and
``readers.read_boxes`` run functions over image bytes; ``results.documents`` takes a ``TextRecogniser`` as its ``read``.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class RegionDetector(Protocol):
    """Regions of a section: image_id, x1, y1, x2, y2 (null: none), confidence, method, from the layout of pages."""

    def __call__(self, layout) -> DataFrame: ...  # noqa: ANN001


@runtime_checkable
class TextDetector(Protocol):
    """Where text is: path, seq, polygon, from path and content of images."""

    def __call__(self, images: DataFrame) -> DataFrame: ...


@runtime_checkable
class TextRecogniser(Protocol):
    """Readings: image_id, section, variant, seq, text, confidence, box, from the boxes inside regions."""

    def __call__(self, boxes: DataFrame) -> DataFrame: ...
