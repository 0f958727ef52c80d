"""Sinks of streams whose effects happen once: batches that come again after a restart are passed over."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.text import extension
from rasterloom.sources.blobs import _at, delete_blobs, write_blobs

logger = logging.getLogger(__name__)


def once(work: Callable[[DataFrame, int], None], manifest: str, swallow: bool = False) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch. A batch's number is written to the manifest, a folder, when its work is done; one
    that is there isn't worked on again. Work that ended before it could be noted runs again, so it should leave the
    same files. swallow: failures are logged and noted, and the stream goes on."""

    def run(batch: DataFrame, number: int) -> None:
        store, folder = _at(manifest)
        store.create_dir(folder, recursive=True)
        note = f"{folder}/{number:012d}"
        if store.get_file_info(note).is_file:
            logger.info("batch %s is done already", number)
            return
        outcome = "done"
        try:
            work(batch, number)
        except Exception as e:
            if not swallow:
                raise
            logger.exception("batch %s failed", number)
            outcome = f"failed: {e}".splitlines()[0]
        with store.open_output_stream(f"{note}.part") as f:
            f.write(outcome.encode())
        store.move(f"{note}.part", note)

    return run


def keep_last_sent(folder: str, manifest: str) -> Callable[[DataFrame, int], None]:
    """Of rows (path, content, mask, ts), the last source and the last mask, under the fixed names that are kept for
    looking at: last_sent_image with the source's extension, last_sent_mask.png. Failures don't stop the stream."""

    def work(batch: DataFrame, number: int) -> None:
        last = batch.agg(F.max_by(F.struct("path", "content", "mask"), "ts").alias("r")).where("r is not null").select("r.*")
        image = last.select(F.concat(F.lit("last_sent_image"), extension(F.col("path"), "")).alias("name"), "content")
        mask = last.select(F.lit("last_sent_mask.png").alias("name"), F.col("mask").alias("content"))
        write_blobs(image.union(mask).where("content is not null"), folder)

    return once(work, manifest, swallow=True)


def delete_evicted(manifest: str) -> Callable[[DataFrame, int], None]:
    """Deletes the files of a stream's column `path`; those that are gone are passed over, failures logged."""
    return once(lambda batch, number: logger.info("batch %s: %s deleted", number, delete_blobs(batch.sparkSession, batch)), manifest, swallow=True)
