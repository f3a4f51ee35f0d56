"""Pictures as they come in. The stages keep no state, so a stream runs the same plan as a table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from glyphflow.plans.pipeline import OcrPipeline
from glyphflow.schema import OcrOptions
from glyphflow.sources.images import stream_images


def detect_stream(spark: SparkSession, pipeline: OcrPipeline, path: str, to: str, checkpoint: str, options: OcrOptions | None = None) -> StreamingQuery:
    """Reads what lies in a folder and what comes next into Parquet; restarts go on from the checkpoint."""
    images = stream_images(spark, path)
    out = pipeline.detect(images.selectExpr("image.origin AS origin", "image"), options)
    return out.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
