"""Width, height, duration and grey frames of image and video files, by ffprobe and ffmpeg where the rows are."""

from __future__ import annotations

import json
import math
import os
import shutil
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Where frames are taken, and the 9 by 8 pixels of a frame.
FRACTIONS = (0.10, 0.35, 0.65, 0.90)
PIXELS = 72
SCHEMA = "path string, kind string, width int, height int, duration double, frames array<binary>"


def tool(name: str, given: str | None = None) -> str | None:
    """The program ``given`` (on the path, or a file), or else ``name`` on the path; None if there is none."""
    if given is None:
        return shutil.which(name)
    return shutil.which(given) or (given if os.path.isfile(given) else None)


def _probe(ffprobe: str, path: str) -> tuple[int, int, float]:
    command = [ffprobe, "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=width,height:format=duration", "-of", "json", path]
    told = json.loads(subprocess.run(command, capture_output=True, check=True).stdout or "{}")
    stream, shape = next(iter(told.get("streams") or [{}])), told.get("format") or {}
    try:
        duration = float(shape.get("duration") or 0.0)
    except (TypeError, ValueError):
        duration = 0.0
    width, height = (int(stream.get(side) or 0) for side in ("width", "height"))  # 0 where no stream tells it
    return width, height, max(0.0, duration) if math.isfinite(duration) else 0.0


def _frame(ffmpeg: str, path: str, at: float) -> bytes:
    command = [ffmpeg, "-v", "error", "-ss", f"{at:.3f}", "-i", path, "-frames:v", "1", "-vf", "scale=9:8:flags=area,format=gray", "-f", "rawvideo", "-"]
    found = subprocess.run(command, capture_output=True, check=True).stdout
    if len(found) < PIXELS:
        raise ValueError("the frame is too short")
    return found[:PIXELS]


def probed(files: DataFrame, ffprobe: str, ffmpeg: str) -> DataFrame:
    """``(path, kind, width, height, duration, frames)`` of ``files(path, kind)`` that are images or videos.

    An image has one frame, at 0 seconds; a video has four, at fractions of its duration. A file that can't be read has
    no row, so that it is tried again in the next run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    width, height, duration = _probe(ffprobe, path)
                    times = [f * duration for f in FRACTIONS] if kind == "video" else [0.0]
                    out.append((path, kind, width, height, duration, [_frame(ffmpeg, path, t) for t in times]))
                except (OSError, subprocess.CalledProcessError, ValueError, KeyError, IndexError, TypeError):
                    continue
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.binary()))
            names = ("path", "kind", "width", "height", "duration", "frames")
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=list(names))

    return files.where("kind in ('image', 'video')").select("path", "kind").mapInArrow(run, SCHEMA)
