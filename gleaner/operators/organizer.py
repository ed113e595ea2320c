"""The media organizer: names parsed to titles, one canonical file for each, and destinations without conflicts."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LIBRARY, base_name, once, safe_title, strip, suffix
from ..sources.scratch import written
from .joins import beside, lookup
from .numbering import within

# A title of one character or more, separators, two digits each for season and episode, four for a year.
SHOW = r"(?diu)(.+?)[ ._-]+s(\p{Nd}{2})e(\p{Nd}{2})"
MOVIE = r"(?d)(.+?)[ ._-]*\((\p{Nd}{4})\)"
#: The decimal digits of all scripts, and what they say.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
ASCII = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def resolution(name):
    low = F.lower(name)
    return F.when(low.contains("2160p") | low.contains("4k"), 2160).when(low.contains("1080p"), 1080).when(low.contains("720p"), 720).when(low.contains("480p"), 480).otherwise(0)


def parse(names: DataFrame) -> DataFrame:
    """``names(source, size)`` of library media: title, year, season, episode, resolution_score, extension and dedupe_key.

    A title can be empty, in the key too: only the name of a destination says "Unknown" then.
    """
    rows = names.withColumn("extension", suffix(F.col("source"))).where(F.col("extension").isin(["." + x for x in LIBRARY]))
    stem = F.expr("left(substring_index(source, '/', -1), length(substring_index(source, '/', -1)) - length(extension))")
    rows = once(rows, stem=stem)
    show, movie = F.col("stem").rlike(SHOW), F.col("stem").rlike(MOVIE)
    plain = lambda c: strip(F.regexp_replace(c, "[._]", " "))
    title = F.when(show, plain(F.regexp_extract("stem", SHOW, 1))).when(movie, plain(F.regexp_extract("stem", MOVIE, 1)))
    title = title.otherwise(strip(F.regexp_replace("stem", r"[._\-]+", " ")))
    rows = once(rows, form=F.when(show, "show").when(movie, "movie").otherwise("unknown"), title=title)
    number = lambda form, pattern, k: F.when(F.col("form") == form, F.try_to_number(F.translate(F.regexp_extract("stem", pattern, k), DIGITS, ASCII), F.lit("9999")).cast("int"))
    rows = rows.withColumn("year", number("movie", MOVIE, 2)).withColumn("season", number("show", SHOW, 2)).withColumn("episode", number("show", SHOW, 3))
    low, two = F.lower("title"), lambda c: F.format_string("%02d", F.col(c))
    key = F.when(F.col("form") == "show", F.concat(F.lit("show:"), low, F.lit("|s"), two("season"), F.lit("e"), two("episode")))
    key = key.when(F.col("form") == "movie", F.concat(F.lit("movie:"), low, F.lit("|"), F.col("year").cast("string"))).otherwise(F.concat(F.lit("unknown:"), low))
    return rows.select("source", "title", "year", "season", "episode", resolution(F.col("stem")).alias("resolution_score"), "size", "extension", key.alias("dedupe_key"), "form")


def canonical(records: DataFrame) -> DataFrame:
    """``(dedupe_key, best)``: the source with the highest resolution, then the largest, the shortest path, the first."""
    rank = F.min(F.struct((-F.col("resolution_score")).alias("r"), (-F.col("size")).alias("s"), F.length("source").alias("l"), "source"))
    return records.groupBy("dedupe_key").agg(rank.alias("top")).select("dedupe_key", F.col("top.source").alias("best"))


def placed(records: DataFrame, target: str, duplicates: str = "Duplicates", unsorted: str = "Unsorted") -> DataFrame:
    """``records`` with base and duplicate: canonical files go to the library, the others to the duplicates folder."""
    rows = lookup(records, written(canonical(records), "canonical"), ["dedupe_key"]).withColumn("duplicate", F.col("source") != F.col("best"))
    rows = once(rows, safe=safe_title(F.col("title")))
    t, two = F.col("safe"), lambda c: F.format_string("%02d", F.col(c))
    year = F.concat(t, F.lit(" ("), F.col("year").cast("string"), F.lit(")"))
    place = F.when(F.col("form") == "show", F.concat(F.lit("TV/"), t, F.lit("/Season "), two("season"), F.lit("/"), t, F.lit(" - S"), two("season"), F.lit("E"), two("episode"), F.col("extension")))
    place = place.when(F.col("form") == "movie", F.concat(F.lit("Movies/"), year, F.lit("/"), year, F.col("extension"))).otherwise(F.concat(F.lit(unsorted + "/"), t, F.col("extension")))
    base = F.when(F.col("duplicate"), F.concat(F.lit(duplicates + "/"), base_name(F.col("source")))).otherwise(place)
    return once(rows, base=F.concat(F.lit(target.rstrip("/") + "/"), base))


def status() -> F.Column:
    return F.when(F.col("duplicate"), "duplicate").otherwise("organized").alias("status")


def destination() -> F.Column:
    """The base of the first, and from the second on the number before the suffix."""
    numbered = F.expr("concat(left(base, length(base) - length(ending)), ' (', n, ')', right(base, length(ending)))")
    return F.when(F.col("n") == 1, F.col("base")).otherwise(numbered).alias("destination")


def plan(records: DataFrame, target: str, duplicates: str = "Duplicates", unsorted: str = "Unsorted", existing: DataFrame | None = None) -> DataFrame:
    """``(source, destination, status)``: where files go in a target that holds ``existing(path)``; none where that is not given.

    Files that come to one destination are numbered from (2), by dedupe_key and source, beside all names that are taken.
    """
    rows = placed(records, target, duplicates, unsorted).select("source", "dedupe_key", "base", "duplicate")
    if existing is None:
        existing = records.sparkSession.createDataFrame([], "path string")
    return versioned(rows, existing).select("source", "destination", status())


def taken_numbers(paths: DataFrame) -> DataFrame:
    """``(base, n)``: for every name that ``paths(path)`` take, the numbers of its versions; 1 is the name itself."""
    name = r"(?s)^(.*) \(([1-9]\d{0,8})\)$"
    rows = paths.withColumn("ending", suffix(F.col("path"))).withColumn("stem", F.expr("left(path, length(path) - length(ending))"))
    n = F.try_to_number(F.regexp_extract("stem", name, 2), F.lit("999999999")).cast("int")
    return rows.select(F.col("path").alias("base"), F.lit(1).alias("n")).union(rows.select(F.concat(F.regexp_extract("stem", name, 1), F.expr("right(path, length(ending))")), n.alias("n")).where("n > 1"))


def free_numbers(rows: DataFrame, existing: DataFrame, many: int = 10_000) -> DataFrame:
    """``rows(base, dedupe_key, source, ...)`` with n: in the order of dedupe_key and source each row of a base has the next number that ``existing(path)`` leaves.

    Bases with up to ``many`` rows and as many taken numbers are one group each. Those with more are numbered over ranges: a row's rank, and
    behind it the taken numbers that come before its own. The k-th taken number t has t - k free ones below it, so that row r skips it if t - k < r.
    """
    taken = taken_numbers(existing).join(rows.select("base").distinct(), "base", "left_semi").distinct()
    sizes = rows.groupBy("base").agg(F.count("*").alias("_n")).unionByName(taken.groupBy("base").agg(F.count("*").alias("_n"))).where(F.col("_n") > many)
    large = written(sizes.groupBy("base").agg(F.sum("_n").alias("_n"), F.lit(True).alias("large")), "large")
    if large.isEmpty():
        return _by_base(rows, taken)
    parts = [beside(x, large, ["base"]).withColumn("large", F.coalesce("large", F.lit(False))) for x in (rows, written(taken, "taken"))]
    few, lots = ([x.where(F.col("large") == is_large).drop("large") for x in parts] for is_large in (False, True))
    return _by_base(*few).unionByName(_over_ranges(*lots))


def _by_base(rows: DataFrame, taken: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("base").orderBy("dedupe_key", "source"))
    lists = taken.groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("taken"))
    ranked = rows.join(lists, "base", "left").withColumn("rank", rank)
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("rank"), lambda n, x: F.when(x <= n, n + 1).otherwise(n))
    return ranked.select(*rows.columns, free.alias("n"))


def _over_ranges(rows: DataFrame, taken: DataFrame) -> DataFrame:
    ranked = within(rows, ["base"], ["dedupe_key", "source"], "rank")
    passed = within(taken, ["base"], ["n"], "k").select("base", (F.col("n") - F.col("k") + 1).alias("place"), F.lit(0).alias("late"))
    both = ranked.withColumn("place", F.col("rank")).withColumn("late", F.lit(1)).unionByName(passed, allowMissingColumns=True)
    told = within(both, ["base"], ["place", "late"], "_at", {"skipped": 1 - F.col("late")})
    return told.where("late = 1").select(*rows.columns, (F.col("rank") + F.col("skipped")).cast("int").alias("n"))


def versioned(rows: DataFrame, existing: DataFrame, many: int = 10_000) -> DataFrame:
    """``rows(base, dedupe_key, source, ...)`` with destination: names that neither ``existing(path)`` nor another row has.

    In the order of dedupe_key and source each row of a base takes the next free number (see ``free_numbers``). A name with a number can be
    another row's base; such rows (most often none) are numbered again beside all names that are settled.
    """
    columns = [c for c in rows.columns if c != "destination"]
    settled, open_rows = None, rows.select(*columns)
    while True:
        named = free_numbers(open_rows, existing, many).withColumn("ending", suffix(F.col("base"))).select(*columns, destination())
        first = F.row_number().over(Window.partitionBy("destination").orderBy(F.col("destination") != F.col("base"), "dedupe_key", "source"))
        named = written(named.withColumn("first", first == 1), "named")
        good = named.where("first").drop("first")
        settled = good if settled is None else settled.union(good)
        open_rows = named.where("not first").select(*columns)
        if open_rows.isEmpty():
            return settled
        existing = existing.select("path").union(good.select(F.col("destination").alias("path")))


def current(records: DataFrame, state: DataFrame, existing: DataFrame) -> DataFrame:
    """``(source, destination)`` of files that an earlier run has handled: the same digest, and the destination is there."""
    known = state.select(F.col("source_path").alias("source"), "source_hash", F.coalesce("destination_path", F.lit("")).alias("destination"))
    return records.join(known, ["source", "source_hash"]).select("source", "destination").join(existing.select(F.col("path").alias("destination")), "destination", "left_semi")


STATE = "source_path string, source_hash string, destination_path string, destination_hash string, status string, updated_at timestamp"


def unchanged(planned: DataFrame, state: DataFrame) -> DataFrame:
    """``planned`` with status already-current where the state has the source at that destination."""
    known = state.select(F.col("source_path").alias("source"), F.coalesce("destination_path", F.lit("")).alias("_at"))
    status = F.when(F.col("_at") == F.col("destination"), "already-current").otherwise(F.col("status"))
    return planned.join(known, "source", "left").select("source", "destination", status.alias("status"))
