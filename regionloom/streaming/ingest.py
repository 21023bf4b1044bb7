"""Heatmaps that arrive as files: an extension, as batch evaluation reads finished files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids as G
from ..operators import regions
from ..sources.readers import HEATMAP


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON-lines files of a folder; rows that are no heatmap are left out."""
    rows = spark.readStream.schema(HEATMAP).json(folder)
    return rows.where(F.col("image_path").isNotNull() & G.is_rectangular(F.col("heatmap")))


def boxes_stream(heatmaps: DataFrame, percentile: float = 0.9, min_area_ratio: float = 0.001, component: str = "max-score") -> DataFrame:
    """Peak and threshold of each heatmap as it comes: built-in expressions, so any sink and output mode will do."""
    flat = F.flatten("heatmap")
    return heatmaps.select("image_path", G.threshold(flat, percentile).alias("threshold"), F.array_max(flat).alias("peak"), G.peak(flat).alias("peak_at"), G.width(F.col("heatmap")).alias("width"), G.height(F.col("heatmap")).alias("height"))


def start_boxes(heatmaps: DataFrame, out: str, checkpoint: str, percentile: float = 0.9, min_area_ratio: float = 0.001, component: str = "max-score"):
    """Writes the box of every arriving heatmap; a batch that is run again replaces its own folder, so each counts once."""

    def batch(df: DataFrame, number: int) -> None:
        made = regions.heatmap_boxes(df, ["image_path"], percentile, min_area_ratio, component)
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return heatmaps.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(events: DataFrame, time: str = "ts", status: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts of a status stream; rows later than the watermark are not counted."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), status).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), status, "n")
