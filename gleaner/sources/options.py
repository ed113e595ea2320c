"""Options of the file operators: an INI file for duplicates, lines of ``key: value`` for the organizer."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class DuplicateOptions:
    """Worker counts are numbers of partitions for hashing and probing; None leaves them to Spark. An empty cache_db: no store.

    ``prune`` says which signatures go after a run: those of all files that it has not seen ("all"), or only of such below
    its own folders ("roots"). With ``collapse_hardlinks`` names of one file (device and inode) are no duplicates of each other.
    """

    dup_dir: str = "/tmp/gleaner/dups"
    mode: str = "media"
    cache_db: str = ".gleaner-store"
    hash_workers: int | None = None
    media_workers: int | None = None
    enabled: bool = True
    ffmpeg_path: str | None = None
    ffprobe_path: str | None = None
    image_hamming_threshold: int = 8
    video_hamming_threshold: int = 32
    video_frame_hamming_threshold: int = 12
    duration_bucket_seconds: int = 2
    prune: str = "all"
    collapse_hardlinks: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("exact", "media"):
            raise ValueError(f"mode is exact or media, not {self.mode!r}")
        if self.prune not in ("all", "roots"):
            raise ValueError(f"prune is all or roots, not {self.prune!r}")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" or (f.type == "int | None" and value is not None):
                positive = f.name == "duration_bucket_seconds" or f.name.endswith("_workers")
                if not isinstance(value, int) or value < positive:
                    raise ValueError(f"{f.name} is too small or no whole number")

    def with_given(self, **given: object) -> DuplicateOptions:
        """These options, but for those given that are not None: arguments come before a file, a file before defaults."""
        return replace(self, **{k: v for k, v in given.items() if v is not None})

    def prepared(self) -> DuplicateOptions:
        """Absolute paths; the folder for duplicates and the one that holds the store are made, ValueError if they can't be."""
        top, store = os.path.abspath(self.dup_dir), os.path.abspath(self.cache_db) if self.cache_db else ""
        try:
            os.makedirs(top, exist_ok=True)
            if store:
                os.makedirs(os.path.dirname(store), exist_ok=True)
        except OSError as e:
            raise ValueError(f"a folder can't be made: {e}") from e
        if not os.access(top, os.W_OK):
            raise ValueError(f"dup_dir is not writable: {top}")
        return replace(self, dup_dir=top, cache_db=store)


@dataclass(frozen=True)
class OrganizerOptions:
    preset: str = "plex"
    duplicates_dir_name: str = "Duplicates"
    unsorted_dir_name: str = "Unsorted"
    dry_run: bool = True


def truth(text: str) -> bool:
    """One of the words that an INI file may use; another one is a ValueError."""
    try:
        return configparser.ConfigParser.BOOLEAN_STATES[text.strip().lower()]
    except KeyError:
        raise ValueError(f"neither yes nor no: {text!r}") from None


def lenient(text: str) -> bool:
    """In the organizer's file any other word says no."""
    return configparser.ConfigParser.BOOLEAN_STATES.get(text.strip().lower(), False)


def _typed(kind: type, given: dict[str, str], boolean=truth):
    reads = {"int": int, "int | None": int, "bool": boolean, "str": str, "str | None": str}
    return kind(**{f.name: reads[f.type](given[f.name]) for f in fields(kind) if f.name in given})


def duplicate_options(path: str) -> DuplicateOptions:
    """Sections ``global`` and ``media``; other keys are passed over."""
    if not Path(path).is_file():
        raise ValueError(f"no configuration file {path}")
    ini = configparser.ConfigParser()
    ini.read(path)
    return _typed(DuplicateOptions, {k: v for s in ("global", "media") if ini.has_section(s) for k, v in ini.items(s)})


def organizer_options(path: str) -> OrganizerOptions:
    """Lines ``key: value``, the last one of a key wins; a missing file gives the defaults."""
    lines = Path(path).read_text().splitlines() if Path(path).is_file() else []
    pairs = [x.partition(":") for x in lines if ":" in x and not x.lstrip().startswith("#")]
    return _typed(OrganizerOptions, {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}, lenient)


def write_organizer_options(path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("".join(f"{f.name}: {str(f.default).lower() if f.type == 'bool' else f.default}\n" for f in fields(OrganizerOptions)))
