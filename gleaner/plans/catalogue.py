"""The file operators as queries over the given tables read as file inventories, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import full_blake2b, quick_blake2b, sample_offsets
from ..functions.text import kind, once, safe_title, split_extension
from ..operators import exact, organizer, perceptual, store
from ..operators.joins import lookup
from ..operators.numbering import numbered
from ..sources.scratch import folder, written


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: a path with an extension by id, bytes as content, times with ties."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ending = F.element_at(F.array(*map(F.lit, [".txt", ".JPG", ".mp4", ".mkv"])), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ending)
    return d.select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), ((F.col("doc_id") % 97) * 1_000_000_000).alias("mtime_ns"), F.lit(1).cast("long").alias("dev"), F.col("doc_id").alias("ino"), F.col("text").cast("binary").alias("content"), "lang")


FILES = """files as (select '/' || source || '/' || lang || '/' || doc_id || (case doc_id % 4 when 0 then '.txt' when 1 then '.JPG' when 2 then '.mp4' else '.mkv' end) as path,
    strlen(text)::bigint as size, (doc_id % 97) * 1000000000 as mtime_ns, 1::bigint as dev, doc_id as ino, hex(text) as hx, sha256(text) as full_sig, lang from documents)"""
KIND = "case doc_id % 4 when 0 then 'other' when 1 then 'image' else 'video' end"
OFFSETS = lambda s: f"list_distinct([0::bigint, least(size // 2, greatest(0, size - {s})), greatest(0, size - {s})])"
SORTED = lambda s: f"list_sort({OFFSETS(s)})"
QUICK = lambda s: f"sha256(unhex(list_reduce(list_transform({SORTED(s)}, lambda o: substr(hx, (2 * o + 1)::bigint, {2 * s})), lambda a, b: a || b)))"
SIZES = {"en": (1920, 1080), "fr": (1280, 720), "de": (640, 480), "es": (720, 576)}
WIDTH, HEIGHT = (f"case lang {' '.join(f'when {k!r} then {v[i]}' for k, v in SIZES.items())} end" for i in (0, 1))
DHASH = lambda at: f"""(select case when v >= 9223372036854775808 then (v - 18446744073709551616)::bigint else v::bigint end from (select list_sum(list_transform(range(64), lambda n:
    case when substr(hx, 2 * (({at} + n // 8 * 9 + n % 8))::bigint + 1, 2) > substr(hx, 2 * ({at} + n // 8 * 9 + n % 8 + 1)::bigint + 1, 2) then pow(2, 63 - n)::hugeint else 0::hugeint end)) as v))"""  # noqa: E731
PREFIX = lambda h: f"(({h} >> 48) & 65535)"


def inventory(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("extension", split_extension(F.col("path")))
    return f.select("path", "size", "mtime_ns", "extension", kind(F.col("extension")).alias("kind"))


def kind_counts(spark, sf_dir):
    return inventory(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def size_groups(spark, sf_dir):
    return files(spark, sf_dir).groupBy("size").agg(F.count("*").alias("files")).where("files > 1")


def size_candidates(spark, sf_dir):
    return exact.repeated(files(spark, sf_dir).select("path", "size"), "size")


def quick_offsets(spark, sf_dir):
    n = F.size(sample_offsets(F.col("size"), 64))
    return files(spark, sf_dir).select("path", n.cast("long").alias("n_samples"), (n * F.least(F.col("size"), F.lit(64))).cast("long").alias("bytes_read"))


def quick_candidates(spark, sf_dir):
    quick = exact.quick_signatures(files(spark, sf_dir), 16)
    return exact.repeated(quick, "size", "quick").select("path", F.col("quick").alias("quick_sig"))


def full_candidates(spark, sf_dir):
    signed = exact.signatures(files(spark, sf_dir), 16)
    return exact.repeated(signed, "size", "quick", "full").select("path", F.col("full").alias("full_sig"))


def exact_duplicates(spark, sf_dir):
    return exact.duplicates(exact.signatures(files(spark, sf_dir), 64))


def survivors(spark, sf_dir):
    stay = exact.survivors(files(spark, sf_dir), exact_duplicates(spark, sf_dir))
    return stay.groupBy("size").agg(F.count("*").alias("n_paths"), F.min("path").alias("first_path"))


def run_stats(spark, sf_dir):
    f = files(spark, sf_dir)
    quick = exact.quick_signatures(f, 64)
    return exact.statistics(f, quick, exact.full_signatures(f, quick), 64)


def sized(f):
    width, height = (F.element_at(F.create_map(*[F.lit(x) for k, v in SIZES.items() for x in (k, v[i])]), F.col("lang")) for i in (0, 1))
    return f.withColumn("width", width).withColumn("height", height)


def frames(spark, sf_dir):
    hashed = once(files(spark, sf_dir).where("size >= 72"), h=perceptual.dhash(F.col("content")))
    return sized(hashed).select("path", "ino", "h", "width", "height")


def dhash(spark, sf_dir):
    return frames(spark, sf_dir).select(F.col("ino").alias("doc_id"), F.col("h").alias("dhash"))


def _links(found):
    return found.select(F.col("a").alias("left"), F.col("b").alias("right"), "score", "pairs")


def clips(spark, sf_dir):
    f = sized(once(files(spark, sf_dir).where("size >= 288"), hashes=F.array(*[perceptual.dhash(F.col("content"), 72 * i) for i in range(4)])))
    return f.select("path", "hashes", "width", "height", (F.col("size") / 500.0).alias("duration"))


def _pairs(classes, found, members):
    """Links of classes, and the members of every class of two rows or more: a row (rep, path) with score 0 each.

    Two rows are similar if their classes are linked or the same. The row of the rep itself has the pairs within its class, the others none:
    all pairs add up to those of the rows.
    """
    several = written(classes.where("n > 1").select("key", "hashes", "rep", "n"), "several")
    within = F.when(F.col("path") == F.col("rep"), F.expr("n * (n - 1) div 2")).otherwise(0)
    return _links(found).unionByName(lookup(members, several, ["key", "hashes"]).select(F.col("rep").alias("left"), F.col("path").alias("right"), F.lit(0).alias("score"), within.alias("pairs")))


def image_pairs(spark, sf_dir):
    """Images of one block that are similar: links of the first paths of classes of equal frames, with the pairs of images that they stand for, and members."""
    return _pairs(*perceptual.image_links(frames(spark, sf_dir)))


def video_pairs(spark, sf_dir):
    return _pairs(*perceptual.video_links(clips(spark, sf_dir)))


def image_links(spark, sf_dir):
    """The same of all frames, whatever their blocks."""
    return _links(perceptual.image_links(frames(spark, sf_dir), blocking="none")[1])


def image_members(spark, sf_dir):
    """The class of every frame, whatever its block: pairs of one class have score 0."""
    return perceptual.named_members(*perceptual.marked(frames(spark, sf_dir), None, "h"))


def video_links(spark, sf_dir):
    return _links(perceptual.video_links(clips(spark, sf_dir), blocking="none")[1])


def clusters(spark, sf_dir):
    return perceptual.image_clusters(frames(spark, sf_dir))[0]


def cluster_numbers(spark, sf_dir):
    """Clusters numbered over all in the order of their first paths, with the paths that they and those before them hold."""
    found = numbered(clusters(spark, sf_dir).select("first_path", "n_paths"), ["first_path"], "n", {"paths_so_far": F.col("n_paths")})
    return found.select(F.concat(F.lit("media-"), F.col("n").cast("string")).alias("cluster_id"), "first_path", "n_paths", "paths_so_far")


def cluster_members(spark, sf_dir):
    return perceptual.image_clusters(frames(spark, sf_dir))[1]


def stored(spark, sf_dir):
    """What an earlier run has left: some files under another path, some with another time, some without a quick digest."""
    f = files(spark, sf_dir)
    path = F.when(F.col("ino") % 5 == 0, F.concat(F.lit("/old"), F.col("path"))).otherwise(F.col("path"))
    quick = F.when(F.col("ino") % 3 != 0, F.concat(F.lit("q"), F.col("ino").cast("string")))
    none = F.lit(None).cast("string")
    return f.select(path.alias("path"), "size", (F.col("mtime_ns") + F.when(F.col("ino") % 7 == 0, 1).otherwise(0)).alias("mtime_ns"), "dev", "ino", quick.alias("quick_hash"), F.lit("f").alias("full_hash"), none.alias("media_sig"), none.alias("media_meta"), F.lit("run-1").alias("last_seen_run"))


def current(spark, sf_dir):
    """What this run sees: all files, some of them moved since."""
    f, none = files(spark, sf_dir), F.lit(None).cast("string")
    path = F.when(F.col("ino") % 11 == 0, F.concat(F.lit("/new"), F.col("path"))).otherwise(F.col("path"))
    fresh = F.when(F.col("ino") % 2 == 0, F.concat(F.lit("n"), F.col("ino").cast("string")))
    return f.select(path.alias("path"), "size", "mtime_ns", "dev", "ino", fresh.alias("quick_hash"), none.alias("full_hash"), none.alias("media_sig"), none.alias("media_meta"))


def cache_lookup(spark, sf_dir):
    found = store.lookup(current(spark, sf_dir).select("path", *store.IDENTITY), stored(spark, sf_dir))
    return found.select("path", F.col("quick_hash").isNotNull().alias("hit"))


def cache_hits(spark, sf_dir):
    return store.hits(store.lookup(current(spark, sf_dir).select("path", *store.IDENTITY), stored(spark, sf_dir)), "quick_hash")


def cache_merge(spark, sf_dir):
    merged = store.merge(stored(spark, sf_dir), current(spark, sf_dir), "run-2")
    return merged.select("path", "size", "mtime_ns", "ino", "quick_hash", "full_hash", "last_seen_run")


def cache_prune(spark, sf_dir):
    return store.prune(cache_merge(spark, sf_dir), "run-2").select("path", "quick_hash")


def later(spark, sf_dir):
    """What a third run sees: some of the files, some of them changed since."""
    f, none = files(spark, sf_dir).where("ino % 3 = 0"), F.lit(None).cast("string")
    path = F.when(F.col("ino") % 11 == 0, F.concat(F.lit("/new"), F.col("path"))).otherwise(F.col("path"))
    full = F.when(F.col("ino") % 4 == 0, F.concat(F.lit("t"), F.col("ino").cast("string")))
    return f.select(path.alias("path"), "size", (F.col("mtime_ns") + F.when(F.col("ino") % 13 == 0, 5).otherwise(0)).alias("mtime_ns"), "dev", "ino", none.alias("quick_hash"), full.alias("full_hash"), none.alias("media_sig"), none.alias("media_meta"), F.lit("run-3").alias("last_seen_run"))


def _log(spark, sf_dir):
    """The store as a log of three runs; the third one ends what lies below /src1 and it has not seen."""
    log = store.opened(spark, folder(spark, "log"), buckets=16)
    log.append(stored(spark, sf_dir))
    log.append(current(spark, sf_dir).withColumn("last_seen_run", F.lit("run-2")))
    log.append(later(spark, sf_dir), prune=True, roots=["/src1", "/old/src1"])
    return log


def cache_log(spark, sf_dir):
    return _log(spark, sf_dir).read().select("path", "size", "mtime_ns", "ino", "quick_hash", "full_hash", "last_seen_run")


def cache_log_lookup(spark, sf_dir):
    asked = files(spark, sf_dir).where("ino % 17 = 0").select("path")
    return _log(spark, sf_dir).lookup(asked).select("path", "mtime_ns", "quick_hash", "full_hash")


def blake_groups(spark, sf_dir):
    """Groups of equal size and equal BLAKE2b digests of samples and of whole contents: their members and the first of them."""
    f = files(spark, sf_dir)
    signed = f.select("path", "size", quick_blake2b(F.col("content"), F.col("size"), 64).alias("quick"), full_blake2b(F.col("content")).alias("full"))
    again = signed.groupBy("size", "quick", "full").agg(F.min("path").alias("first_path"), F.count("*").alias("n_paths")).where("n_paths > 1")
    return signed.join(again, ["size", "quick", "full"]).select("path", "first_path", "n_paths", F.length("quick").alias("quick_digits"), F.length("full").alias("full_digits"))


CACHE = f"""{FILES}, stored as (select case when ino % 5 = 0 then '/old' else '' end || path as path, size, mtime_ns + (case when ino % 7 = 0 then 1 else 0 end) as mtime_ns, dev, ino, case when ino % 3 <> 0 then 'q' || ino end as quick_hash, 'f' as full_hash from files),
    fresh as (select case when ino % 11 = 0 then '/new' else '' end || path as path, size, mtime_ns, dev, ino, case when ino % 2 = 0 then 'n' || ino end as quick_hash, null::varchar as full_hash from files),
    merged as (select coalesce(n.path, o.path) as path, coalesce(n.size, o.size) as size, coalesce(n.mtime_ns, o.mtime_ns) as mtime_ns, coalesce(n.ino, o.ino) as ino,
        case when n.path is null then o.quick_hash when o.mtime_ns = n.mtime_ns then coalesce(n.quick_hash, o.quick_hash) else n.quick_hash end as quick_hash,
        case when n.path is null then o.full_hash when o.mtime_ns = n.mtime_ns then coalesce(n.full_hash, o.full_hash) else n.full_hash end as full_hash,
        case when n.path is null then 'run-1' else 'run-2' end as last_seen_run from stored o full join fresh n on o.path = n.path)"""


#: A third run over what the first two have left; it ends what lies below /src1 and it has not seen.
THIRD = f"""{CACHE}, again as (select case when ino % 11 = 0 then '/new' else '' end || path as path, size, mtime_ns + (case when ino % 13 = 0 then 5 else 0 end) as mtime_ns, ino, case when ino % 4 = 0 then 't' || ino end as full_hash from files where ino % 3 = 0),
    thrice as (select coalesce(n.path, o.path) as path, coalesce(n.size, o.size) as size, coalesce(n.mtime_ns, o.mtime_ns) as mtime_ns, coalesce(n.ino, o.ino) as ino,
        case when n.path is null or o.mtime_ns = n.mtime_ns then o.quick_hash end as quick_hash,
        case when n.path is null then o.full_hash when o.mtime_ns = n.mtime_ns then coalesce(n.full_hash, o.full_hash) else n.full_hash end as full_hash,
        case when n.path is null then o.last_seen_run else 'run-3' end as last_seen_run
        from merged o full join again n on o.path = n.path where n.path is not null or not (starts_with(o.path, '/src1/') or starts_with(o.path, '/old/src1/')))"""


def names(spark, sf_dir):
    """``part`` as media file names."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(f"{SPARK_NAME} as source", "cast(floor(p_retailprice) as bigint) as size", "p_partkey", "p_name", "p_size")


def _name(pad: str) -> str:
    base = f"""case p_partkey % 23 when 1 then replace(p_name, ' ', '.') || '.S' || p_size % 10 || 'E' || {pad.format('p_size')} when 2 then '(' || cast(1990 + p_size % 20 as varchar(9)) || ')'
        when 3 then ' S01E0' || p_size % 10 when 4 then '  S01E0' || p_size % 10 when 5 then replace(p_name, ' ', chr(9)) || chr(9) || 'S01E02' when 6 then '_._ S01E01'
        when 7 then 'Unknown - S01E01' when 9 then '._(2001) ' when 10 then 'Twin' when 11 then 'Twin (2)' when 12 then replace(p_name, ' ', '.') || '.S٠' || p_size % 3 || 'E١٢' when 13 then p_name || ' (٢٠١' || p_size % 10 || ')' else case p_partkey % 5 when 0 then replace(p_name, ' ', '.') || '.S' || {pad.format('p_size % 3 + 1')} || 'E' || {pad.format('p_size % 10')}
        when 1 then replace(p_name, ' ', '_') || '_(' || cast(1990 + p_size % 20 as varchar(9)) || ')' when 2 then p_name || '?: ' || cast(p_size as varchar(9))
        when 3 then replace(p_name, ' ', '-') || ' - s01e' || {pad.format('p_size % 10')} else replace(p_name, ' ', '.') || '.(' || cast(1990 + p_size % 20 as varchar(9)) || ')' end end"""
    quality = "case p_partkey % 7 when 0 then '.2160p' when 1 then ' 4K' when 2 then '.1080p' when 3 then '.720p' when 4 then '.480p' else '' end"
    return f"'/in/' || lower(p_brand) || '/' || p_partkey || '/' || {base} || {quality} || case p_partkey % 6 when 0 then '.MKV' when 4 then '.flv' when 5 then '.txt' else '.mp4' end"


RANK = "row_number() over (partition by base order by dedupe_key, source)"
FREE = "({0} + len(list_filter(range(1, len(t) + 1), lambda i: t[i] - i < {0})))"  # the number with that many free ones up to it
NUMBERED = "left(base, length(base) - length(ending)) || ' (' || n || ')' || ending"
SPARK_NAME = _name("lpad(cast({} as varchar(9)), 2, '0')")
NAMES = f"""names as (select {SPARK_NAME} as source, floor(p_retailprice)::bigint as size from part),
    stems as (select *, lower(regexp_extract(source, '(\\.[^./]+)$', 1)) as extension, regexp_replace(regexp_replace(source, '^.*/', ''), '\\.[^.]+$', '') as stem from names),
    media as (select *, case when regexp_matches(stem, '(?i)(.+?)[ ._-]+s(\\p{{Nd}}{{2}})e(\\p{{Nd}}{{2}})') then 'show' when regexp_matches(stem, '(.+?)[ ._-]*\\((\\p{{Nd}}{{4}})\\)') then 'movie' else 'unknown' end as form
        from stems where extension in ('.mkv', '.mp4', '.avi', '.mov', '.m4v', '.wmv', '.ts', '.webm')),
    parsed as (select *, case form when 'show' then regexp_replace(replace(replace(regexp_extract(stem, '(?i)(.+?)[ ._-]+s(\\p{{Nd}}{{2}})e(\\p{{Nd}}{{2}})', 1), '.', ' '), '_', ' '), '^\\s+|\\s+$', '', 'g')
            when 'movie' then regexp_replace(replace(replace(regexp_extract(stem, '(.+?)[ ._-]*\\((\\p{{Nd}}{{4}})\\)', 1), '.', ' '), '_', ' '), '^\\s+|\\s+$', '', 'g') else regexp_replace(regexp_replace(stem, '[._-]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') end as title,
        case when form = 'movie' then translate(regexp_extract(stem, '(.+?)[ ._-]*\\((\\p{{Nd}}{{4}})\\)', 2), '٠١٢٣٤٥٦٧٨٩', '0123456789')::int end as year,
        case when form = 'show' then translate(regexp_extract(stem, '(?i)(.+?)[ ._-]+s(\\p{{Nd}}{{2}})e(\\p{{Nd}}{{2}})', 2), '٠١٢٣٤٥٦٧٨٩', '0123456789')::int end as season,
        case when form = 'show' then translate(regexp_extract(stem, '(?i)(.+?)[ ._-]+s(\\p{{Nd}}{{2}})e(\\p{{Nd}}{{2}})', 3), '٠١٢٣٤٥٦٧٨٩', '0123456789')::int end as episode,
        case when lower(stem) like '%2160p%' or lower(stem) like '%4k%' then 2160 when lower(stem) like '%1080p%' then 1080 when lower(stem) like '%720p%' then 720 when lower(stem) like '%480p%' then 480 else 0 end as resolution_score from media),
    keyed as (select *, case form when 'show' then 'show:' || lower(title) || '|s' || lpad(season::varchar, 2, '0') || 'e' || lpad(episode::varchar, 2, '0') when 'movie' then 'movie:' || lower(title) || '|' || year else 'unknown:' || lower(title) end as dedupe_key,
        coalesce(nullif(trim(regexp_replace(regexp_replace(title, '[\\\\/:*?"<>|]', '', 'g'), '\\s+', ' ', 'g')), ''), 'Unknown') as safe from parsed),
    ranked as (select *, row_number() over (partition by dedupe_key order by resolution_score desc, size desc, length(source), source) as rank from keyed),
    placed as (select *, '/library/' || case when rank > 1 then 'Duplicates/' || regexp_replace(source, '^.*/', '') when form = 'show' then 'TV/' || safe || '/Season ' || lpad(season::varchar, 2, '0') || '/' || safe || ' - S' || lpad(season::varchar, 2, '0') || 'E' || lpad(episode::varchar, 2, '0') || extension
        when form = 'movie' then 'Movies/' || safe || ' (' || year || ')/' || safe || ' (' || year || ')' || extension else 'Unsorted/' || safe || extension end as base from ranked),
    numbered as (select *, {RANK} as n, count(*) over (partition by base) as total, regexp_extract(base, '(\\.[^./]+)$', 1) as ending from placed),
    checked as (select *, n > 1 and {NUMBERED} in (select base from placed) as clash from numbered),
    renumbered as (select * replace (case when clash then total + {RANK.replace('base', 'base, clash')} else n end as n) from checked),
    planned as (select source, case when n = 1 then base else {NUMBERED} end as destination, case when rank > 1 then 'duplicate' else 'organized' end as status from renumbered),
    occupied as (select distinct base as path from placed where length(source) % 10 = 0),
    marks as (select path as base, 1 as k from occupied union select regexp_replace(path, ' \\(\\d+\\)(\\.[^./]+)$', '\\1'), regexp_extract(path, ' \\(([1-9]\\d*)\\)\\.[^./]+$', 1)::bigint from occupied where regexp_matches(path, ' \\([1-9]\\d*\\)\\.[^./]+$')),
    taken as (select base, list_sort(list(distinct k)) as t from marks where k > 0 group by base),
    beside as (select placed.*, {RANK} as r, coalesce(t, []) as t, regexp_extract(base, '(\\.[^./]+)$', 1) as ending from placed left join taken using (base)),
    first as (select *, {FREE.format('r')} as n from beside),
    held as (select *, n > 1 and {NUMBERED} in (select base from first where n = 1) as clash, list(n) over (partition by base) as own from first),
    renamed as (select * replace (list_sort(list_distinct(list_concat(t, own))) as t, {RANK.replace('base', 'base, clash')} as r) from held),
    again as (select * replace (case when clash then {FREE.format('r')} else n end as n) from renamed),
    versions as (select source, case when n = 1 then base else {NUMBERED} end as destination from again)"""


def parsed(spark, sf_dir):
    return organizer.parse(names(spark, sf_dir).select("source", "size"))


def name_parse(spark, sf_dir):
    return parsed(spark, sf_dir).select("source", "title", "year", "season", "episode", "resolution_score", "dedupe_key")


def safe_titles(spark, sf_dir):
    return parsed(spark, sf_dir).select("title", safe_title(F.col("title")).alias("safe"))


def organizer_canonical(spark, sf_dir):
    return organizer.canonical(parsed(spark, sf_dir)).select("dedupe_key", F.col("best").alias("source"))


def organizer_plan(spark, sf_dir):
    return organizer.plan(parsed(spark, sf_dir), "/library")


def organizer_versions(spark, sf_dir):
    """Destinations beside files that are there already: the bases of some of the rows."""
    rows = organizer.placed(parsed(spark, sf_dir), "/library").select("source", "dedupe_key", "base", "duplicate")
    occupied = rows.where(F.length("source") % 10 == 0).select(F.col("base").alias("path")).distinct()
    return organizer.versioned(rows, occupied).select("source", "destination")


def organizer_state(spark, sf_dir):
    planned = organizer_plan(spark, sf_dir)
    state = planned.where(F.length("source") % 3 == 0).select(F.col("source").alias("source_path"), F.when(F.length("source") % 2 == 0, F.col("destination")).otherwise("/old").alias("destination_path"))
    return organizer.unchanged(planned, state).select("source", "status")


def organizer_summary(spark, sf_dir):
    return organizer_plan(spark, sf_dir).groupBy("status").agg(F.count("*").alias("files"))


def organizer_progress(spark, sf_dir):
    """The plan in its order, each row with the files processed and those put in order up to it."""
    planned = organizer_plan(spark, sf_dir).join(parsed(spark, sf_dir).select("source", "dedupe_key"), "source")
    told = numbered(planned, ["dedupe_key", "source"], "processed", {"organized": F.when(F.col("status") == "organized", 1)})
    return told.select("source", "status", "processed", "organized")


QUERIES = {
    f.__name__: f
    for f in (
        inventory, kind_counts, size_groups, size_candidates, quick_offsets, quick_candidates, full_candidates, exact_duplicates, survivors, run_stats, dhash, image_pairs,
        video_pairs, image_links, image_members, video_links, clusters, cluster_members, cluster_numbers, cache_lookup, cache_hits, cache_merge, cache_prune, cache_log, cache_log_lookup, blake_groups, name_parse, safe_titles, organizer_canonical, organizer_plan, organizer_versions, organizer_state, organizer_progress, organizer_summary,
    )
}

MOVED = f"""{FILES}, ranked as (select *, first_value(path) over w as kept, row_number() over w as nth from files window w as (partition by size, full_sig order by mtime_ns, path))"""
IMAGES = f"""{FILES}, frames as (select path, ino, {DHASH(0)} as h, {WIDTH} as width, {HEIGHT} as height from files where size >= 72),
    pairs as (select a.path as "left", b.path as "right", bit_count(xor(a.h, b.h))::int as score from frames a join frames b on a.width // 64 = b.width // 64 and a.height // 64 = b.height // 64
        and {PREFIX('a.h')} = {PREFIX('b.h')} and a.path < b.path where bit_count(xor(a.h, b.h)) <= 8)"""
EACH = [f"bit_count(xor(a.f{i}, b.f{i}))::int" for i in range(4)]
CLIPS = f"{FILES}, clips as (select path, {', '.join(f'{DHASH(72 * i)} as f{i}' for i in range(4))}, {WIDTH} as width, {HEIGHT} as height, size / 500.0::double as duration from files where size >= 288)"
#: Classes of equal marks within a block, and all pairs of unlike ones.
LINKED = lambda marks, block, table, score, more, most: f""", marked as (select path, {marks}, ({block}) as block from {table}), classes as (select {marks}, block, min(path) as rep, count(*) as n from marked group by all)
    select a.rep as "left", b.rep as "right", ({score})::int as score, a.n * b.n as pairs from classes a join classes b on a.block = b.block and a.rep < b.rep where {score} <= {most} and {more}"""  # noqa: E731
#: The members of classes of two rows or more, after LINKED.
HELD = lambda marks: f""" union all select rep, path, 0, case when path = rep then n * (n - 1) // 2 else 0 end
    from (select path, min(path) over w as rep, count(*) over w as n from marked window w as (partition by {marks}, block)) where n > 1"""  # noqa: E731
SQL = {
    "inventory": f"with {FILES} select path, size, mtime_ns, case ino % 4 when 0 then '.txt' when 1 then '.jpg' when 2 then '.mp4' else '.mkv' end as extension, {KIND.replace('doc_id', 'ino')} as kind from files",
    "kind_counts": f"select {KIND} as kind, count(*) as files, sum(strlen(text))::bigint as bytes from documents group by 1",
    "size_groups": f"with {FILES} select size, count(*) as files from files group by 1 having count(*) > 1",
    "size_candidates": f"with {FILES} select path, size from files qualify count(*) over (partition by size) > 1",
    "quick_offsets": f"with {FILES} select path, len({OFFSETS(64)})::bigint as n_samples, (len({OFFSETS(64)}) * least(size, 64))::bigint as bytes_read from files",
    "quick_candidates": f"with {FILES}, s as (select path, size, {QUICK(16)} as quick_sig from files) select path, quick_sig from s qualify count(*) over (partition by size, quick_sig) > 1",
    "full_candidates": f"with {FILES} select path, full_sig from files qualify count(*) over (partition by size, full_sig) > 1",
    "exact_duplicates": f"with {MOVED} select path as source, kept, '/dups' || path as destination from ranked where nth > 1",
    "survivors": f"with {MOVED} select size, count(*) as n_paths, min(path) as first_path from ranked where nth = 1 group by 1",
    "run_stats": f"""with {FILES}, s as (select *, {QUICK(64)} as quick_sig, len({OFFSETS(64)}) * least(size, 64) as sampled from files), n as (select *, count(*) over (partition by size) as a, count(*) over (partition by size, quick_sig) as b, count(*) over (partition by size, quick_sig, full_sig) as c,
        row_number() over (partition by size, full_sig order by mtime_ns, path) as nth from s)
        select count(*) as files_scanned, count(*) filter (a > 1) as size_candidates, count(*) filter (b > 1) as quick_candidates, count(*) filter (c > 1) as full_candidates, count(*) filter (nth > 1) as moved,
        coalesce(sum(case when a > 1 then sampled else 0 end) + sum(case when b > 1 then size else 0 end), 0)::bigint as bytes_read_exact, coalesce(sum(case when nth > 1 then 2 * size else 0 end), 0)::bigint as bytes_read_verify from n""",
    "dhash": f"with {FILES} select ino as doc_id, {DHASH(0)} as dhash from files where size >= 72",
    "image_pairs": f"with {IMAGES} {LINKED('h', 'width // 64, height // 64, ' + PREFIX('h'), 'frames', 'bit_count(xor(a.h, b.h))', 'true', 8)} {HELD('h')}",
    "image_links": f"with {IMAGES} {LINKED('h', '1', 'frames', 'bit_count(xor(a.h, b.h))', 'true', 8)}",
    "image_members": f"with {IMAGES} select path, min(path) over (partition by h) as rep from frames",
    "video_pairs": f"with {CLIPS} {LINKED('f0, f1, f2, f3', f"floor(duration / 2), round_even(width / height * 10, 0), {PREFIX('f0')}", 'clips', ' + '.join(EACH), f"greatest({', '.join(EACH)}) <= 12", 32)} {HELD('f0, f1, f2, f3')}",
    "video_links": f"with {CLIPS} {LINKED('f0, f1, f2, f3', '1', 'clips', ' + '.join(EACH), f"greatest({', '.join(EACH)}) <= 12", 32)}",
    "clusters": f"""with recursive {IMAGES}, e as (select "left" as a, "right" as b from pairs union select "right", "left" from pairs), reach as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a),
        named as (select a, least(a, min(b)) as first_path from reach group by a), n as (select first_path, count(*) as n_paths from named group by 1)
        select first_path, n_paths, count(*) as pairs, min(score) as min_score, max(score) as max_score from pairs join named on "left" = a join n using (first_path) group by 1, 2""",
    "cluster_numbers": f"""with recursive {IMAGES}, e as (select "left" as a, "right" as b from pairs union select "right", "left" from pairs), reach as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a),
        named as (select a, least(a, min(b)) as first_path from reach group by a), n as (select first_path, count(*) as n_paths from named group by 1)
        select 'media-' || row_number() over (order by first_path) as cluster_id, first_path, n_paths, (sum(n_paths) over (order by first_path))::bigint as paths_so_far from n""",
    "cluster_members": f"""with recursive {IMAGES}, e as (select "left" as a, "right" as b from pairs union select "right", "left" from pairs), reach as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a)
        select a as path, least(a, min(b)) as first_path from reach group by a""",
    "cache_lookup": f"with {CACHE} select n.path, o.quick_hash is not null as hit from fresh n left join stored o using (path, size, mtime_ns, dev, ino)",
    "cache_hits": f"with {CACHE}, l as (select o.quick_hash as q from fresh n left join stored o using (path, size, mtime_ns, dev, ino)) select count(q) as hits, count(*) - count(q) as misses, count(q) / count(*) as hit_ratio from l",
    "cache_merge": f"with {CACHE} select * from merged",
    "cache_prune": f"with {CACHE} select path, quick_hash from merged where last_seen_run = 'run-2'",
    "cache_log": f"with {THIRD} select path, size, mtime_ns, ino, quick_hash, full_hash, last_seen_run from thrice",
    "cache_log_lookup": f"with {THIRD} select path, mtime_ns, quick_hash, full_hash from thrice where path in (select path from files where ino % 17 = 0)",
    "blake_groups": f"with {FILES}, s as (select path, size, {QUICK(64)} as quick_sig, full_sig from files) select path, min(path) over w as first_path, count(*) over w as n_paths, 32 as quick_digits, 64 as full_digits from s window w as (partition by size, quick_sig, full_sig) qualify count(*) over w > 1",
    "name_parse": f"with {NAMES} select source, title, year, season, episode, resolution_score, dedupe_key from keyed",
    "safe_titles": f"with {NAMES} select title, safe from keyed",
    "organizer_canonical": f"with {NAMES} select dedupe_key, source from ranked where rank = 1",
    "organizer_plan": f"with {NAMES} select * from planned",
    "organizer_versions": f"with {NAMES} select * from versions",
    "organizer_state": f"with {NAMES} select source, case when length(source) % 3 = 0 and length(source) % 2 = 0 then 'already-current' else status end as status from planned",
    "organizer_progress": f"with {NAMES} select source, status, row_number() over (order by dedupe_key, source) as processed, (sum((status = 'organized')::int) over (order by dedupe_key, source))::bigint as organized from planned join keyed using (source)",
    "organizer_summary": f"with {NAMES} select status, count(*) as files from planned group by 1",
}
