"""The command line: duplicates below folders, or the media organizer."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from .operators.moves import write_report
from .plans.duplicates import Duplicates
from .plans.library import Organizer
from .sources.options import DuplicateOptions, duplicate_options, organizer_options, write_organizer_options

LOGGER = logging.getLogger("gleaner")
ORGANIZER_CONFIG, STATE = "organize.yaml", ".gleaner-state"


def folder(text: str) -> str:
    if not os.path.isdir(text):
        raise argparse.ArgumentTypeError(f"no folder: {text}")
    return os.path.abspath(text)


def new_folder(text: str) -> str:
    try:
        os.makedirs(text, exist_ok=True)
    except OSError as e:
        raise argparse.ArgumentTypeError(f"no folder can be made: {text}: {e}") from e
    return os.path.abspath(text)


def file(text: str) -> str:
    if not os.path.isfile(text):
        raise argparse.ArgumentTypeError(f"no file: {text}")
    return os.path.abspath(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("gleaner", description="Moves exact duplicates away, reports similar media, organizes a media library.")
    p.add_argument("-c", "--config", type=file, help="INI file; arguments come before it, and it before defaults")
    p.add_argument("-a", "--alternate", type=new_folder, help="folder that duplicates are moved to")
    p.add_argument("--mode", choices=("exact", "media"))
    p.add_argument("--cache", help="folder of the signature store")
    p.add_argument("--no-cache", action="store_true")
    for name, what in (("hash-workers", "partitions for hashing"), ("media-workers", "partitions for probing"), ("image-hamming-threshold", "bits"), ("video-hamming-threshold", "bits of all frames"), ("video-frame-hamming-threshold", "bits of a frame"), ("duration-bucket-seconds", "seconds")):
        p.add_argument(f"--{name}", type=int, help=what)
    p.add_argument("--no-media", action="store_true", help="no search for similar media")
    p.add_argument("--ffmpeg")
    p.add_argument("--ffprobe")
    p.add_argument("--report-similar", help="JSON file for clusters of similar media")
    p.add_argument("--organize-media", action="store_true", help="run the organizer")
    p.add_argument("--organize-target", help="folder of the library")
    p.add_argument("--organize-config", help="file of `key: value` lines")
    p.add_argument("--organize-state-db", help="folder of the organizer's state")
    p.add_argument("--organize-apply", action="store_true", help="move files (else a dry run)")
    p.add_argument("--organize-report", help="JSON file for the organizer's operations")
    p.add_argument("base", nargs="*", type=folder, help="folders")
    return p


def session() -> SparkSession:
    """The running session, else one as Spark is configured (spark-submit), else a local one."""
    made = SparkSession.builder.appName("gleaner").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def _organize(args: argparse.Namespace) -> None:
    target = os.path.abspath(args.organize_target or os.path.join(args.base[0], "organized"))
    config = args.organize_config
    if config is None:
        config = os.path.abspath(ORGANIZER_CONFIG)
        if not os.path.exists(config):
            write_organizer_options(config)
    state = args.organize_state_db or os.path.join(target, STATE)
    runner = Organizer(session(), args.base, target, organizer_options(config), state, dry_run=not args.organize_apply)
    report = runner.run(lambda told: LOGGER.info("organizer: %s", told))
    if args.organize_report:
        write_report(report, args.organize_report)


def _duplicates(args: argparse.Namespace, p: argparse.ArgumentParser) -> None:
    try:
        options = duplicate_options(args.config) if args.config else DuplicateOptions()
        options = options.with_given(
            dup_dir=args.alternate, mode=args.mode, cache_db=args.cache, hash_workers=args.hash_workers, media_workers=args.media_workers, ffmpeg_path=args.ffmpeg, ffprobe_path=args.ffprobe,
            image_hamming_threshold=args.image_hamming_threshold, video_hamming_threshold=args.video_hamming_threshold, video_frame_hamming_threshold=args.video_frame_hamming_threshold,
            duration_bucket_seconds=args.duration_bucket_seconds, enabled=False if args.no_media else None,
        )
        engine = Duplicates(session(), options, args.no_cache)
    except ValueError as e:
        p.error(str(e))
    LOGGER.info("%d folders", len(args.base))
    engine.run(args.base)
    LOGGER.info("stats: %s", engine.stats.report())
    if args.report_similar:
        engine.report_similar(args.report_similar)


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO)
    p = parser()
    args = p.parse_args(argv)
    if not args.base:
        p.error("at least one folder is needed")
    if args.organize_media:
        _organize(args)
    else:
        _duplicates(args, p)
    return 0


if __name__ == "__main__":
    sys.exit(main())
