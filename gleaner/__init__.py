"""Spark-native analytics over file inventories: exact and perceptual duplicates, media organizing, signature reuse."""

from importlib import import_module

# Imported when asked for: a Python worker that unpickles one function of the package needs none of them.
_EXPORTS = {
    "DuplicateOptions": ("sources.options", "DuplicateOptions"),
    "Duplicates": ("plans.duplicates", "Duplicates"),
    "Organizer": ("plans.library", "Organizer"),
    "OrganizerOptions": ("sources.options", "OrganizerOptions"),
    "get_hash_key": ("functions.digest", "digest_bytes"),
    "process_file": ("functions.digest", "digest_samples"),
}
__all__ = list(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    module, attribute = _EXPORTS[name]
    return getattr(import_module(f".{module}", __name__), attribute)
