"""The operators' queries over their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, embeddings, licenses, main_text, packing, paragraphs, pii, quality, ranking, sharding, simhash, url_filter
from .common import read


#: Not a secret: the key of the queries over synthetic tables where the session names none (``pii.SETTING``).
DEMONSTRATION = b"for synthetic tables only"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_texts(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), pii.session_key(spark, DEMONSTRATION))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read(spark, sf_dir, "pages"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontamination, op3_substrings, op4_quality, op5_embeddings, op6_sharding, op7_licenses, op8_pii, op9_urls, op10_packing, op11_ranking, op12_main_text, op13_centroids)}


def _licenses_sql() -> str:
    """The same canonical form, with the known digests worked out here."""
    table = ", ".join(f"('{d}', '{n}')" for n, d, *_ in licenses.listed())
    respelled = "' ' || replace(c, ' ', '  ') || ' '"
    for a, b in licenses.SPELLINGS.items():
        respelled = f"replace({respelled}, ' {a} ', ' {b.replace(' ', '  ')} ')"
    line = f"case when regexp_matches(x, '{licenses.COPYRIGHT}') and not regexp_matches(x, '{licenses.WORDING}') then '' else trim(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g'))) end"
    return f"""
        with known(digest, license_id) as (values {table}),
        base as (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {line}) as lines from documents),
        units as (
            select doc_id, 'line' as unit, cast(i - 1 as integer) as line, lines[i] as c from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from base)
            union all
            select doc_id, 'document', null, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') from base
        )
        select doc_id, unit, line, license_id from units join known on md5(trim(replace({respelled}, '  ', ' '))) = digest"""


def _urls_sql() -> str:
    """Links, reachable sets by recursion, and rules; the longest rule last, so that it wins."""
    host = lambda u: f"translate(regexp_extract({u}, '://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}')"
    path = lambda u: f"regexp_extract({u}, '://[^/?#]*([^?#]*)', 1)"

    def node(u: str) -> str:
        w = f"regexp_replace(trim({u}), '#[\\s\\S]*$', '')"
        scheme = f"translate(regexp_extract({w}, '^([^:/?#]*)://', 1), '{url_filter.UPPER}', '{url_filter.LOWER}')"
        return f"case when contains({w}, '://') then {scheme} || '://' || {host(w)} || case when {path(w)} = '' then '/' else {path(w)} end || regexp_extract({w}, '://[^?]*(\\?[\\s\\S]*)$', 1) end"

    def rule(h: str, p: str, of: str) -> str:
        cases = [f"when ({h} = '{r[1]}' or ends_with({h}, '.{r[1]}')) and starts_with({p}, '{r[2]}') then '{r[1] + r[2] if of == 'rule' else r[0]}'" for r in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))]
        return f"case {' '.join(cases)} end"

    q = lambda pattern: pattern.replace("'", "''")
    root = f"regexp_extract(url, '^([^:/?#]*)://', 1) || '://' || {host('url')}"
    target = f"""case when regexp_matches(f, '^[A-Za-z][A-Za-z0-9+.-]*://') then f when starts_with(f, '//') then regexp_extract(url, '^([^:/?#]*)', 1) || ':' || f
        when starts_with(f, '/') then {root} || f when f <> '' then {root} || regexp_replace({path('url')}, '[^/]*$', '') || f end"""
    return f"""
        with recursive held as (select url, unnest([regexp_extract(regexp_extract(html, '{q(url_filter.CANONICAL)}'), '{q(url_filter.HREF)}', 1),
            regexp_extract(regexp_extract(html, '{q(url_filter.REFRESH)}'), '{q(url_filter.GOES)}', 1)]) as f from pages where url is not null and html is not null),
        found as (select url, replace(trim(f), '&amp;', '&') as f from held),
        edges as (select {node('url')} as a, {node(f'({target})')} as b from found),
        both_ways as (select a, b from edges where a is not null and b is not null and a <> b union select b, a from edges where a is not null and b is not null and a <> b),
        reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
        acted as (select a, {rule(host('b'), path('b'), 'action')} as action from reach),
        alias as (select a, max(action = 'allow') as allowed, max(action = 'block') as blocked from acted group by a),
        urls as (select page_id, coalesce(url, '') as url from pages),
        rows as (select page_id, {node('url')} as node, {host('url')} as host, {path('url')} as path from urls)
        select page_id, host, path, {rule('host', 'path', 'rule')} as rule,
            coalesce({rule('host', 'path', 'action')}, case when allowed then 'allow' when blocked then 'block' else 'allow' end) as verdict
        from rows left join alias on a = node"""


#: All pairs of equal labels: for tables small enough for that. The index may miss a link that this finds.
_EMBEDDINGS = """
    with recursive every as (select row_number() over () as r, vec_id, label, cast(embedding as double[]) as v from embeddings),
    sound as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from every where vec_id is not null and label is not null and len(v) > 0
        and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
    links as (select a.r as r, a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v)
        where list_dot_product(a.v, b.v) >= 0.98 * a.norm * b.norm),
    edges as (select distinct a, b from links),
    reach as (select a, b from edges union select reach.a, edges.b from reach join edges on reach.b = edges.a),
    least_of as (select a, min(b) as low from reach group by a),
    counted as (select r, count(*) as n from links group by r)
    select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, case when n > 0 then low end)::bigint as component_id,
        coalesce(vec_id <= case when n > 0 then low end, true) as kept
    from every left join counted using (r) left join least_of on a = vec_id"""


def _centroids_sql(number: int = 16, rounds: int = 3) -> str:
    """Every vector against every centroid, dimension by dimension."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"near{n} as materialized (select r, min(struct_pack(d := {apart}, c := c.c)) as best from kept k, c{n} c group by r)")
        sums = f"select best.c as c, i, sum(v[i]) as s, count(*) as n from near{n} join kept using (r), range(1, 65) as t(i) group by best.c, i"
        means = f"select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from ({sums}) group by c"
        if n < rounds:
            steps.append(f"c{n + 1} as materialized (select c{n}.c, coalesce(m.v, c{n}.v) as v from c{n} left join ({means}) m using (c))")
    return f"""
        with sound as (select vec_id, embedding as e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        kept as materialized (select row_number() over () as r, vec_id, list_transform(e, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from sound),
        c0 as materialized (select cast(row_number() over (order by sha256('1:' || vec_id), v) - 1 as integer) as c, v from kept where vec_id is not null order by sha256('1:' || vec_id), v limit {number}),
        {", ".join(steps)},
        found as (select vec_id, best.c as cluster, cast(best.d as bigint) as distance from near{rounds} join kept using (r))
        select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
            sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
        from found join c{rounds} on c{rounds}.c = cluster"""


#: All documents against all items, by a join on terms.
_RANKING = r"""
    with terms as (select doc_id, row_number() over () as r, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
    asked as (select item_id, row_number() over () as q, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) as term from benchmark),
    total as (select count(*)::bigint as n_docs, sum(len(w))::bigint as n_terms from terms where len(w) > 0),
    held as (select r, doc_id, len(w)::bigint as n, unnest(w) as term from terms where len(w) > 0),
    counts as materialized (select r, doc_id, n, term, count(*)::bigint as tf from held group by all),
    weights as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from counts, total group by term),
    gains as (select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) as gain from counts join weights using (term), total),
    scores as (select q, item_id, r, doc_id, sum(gain)::bigint as score from asked join gains using (term) group by all),
    ranked as (select item_id, cast(row_number() over (partition by q order by score desc, doc_id asc nulls last) as integer) as rank, doc_id, score from scores where score > 0)
    select * from ranked where rank <= 20"""


SQL = {"op11_ranking": _RANKING, "op13_centroids": _centroids_sql(), "op5_embeddings": _EMBEDDINGS, "op7_licenses": _licenses_sql(), "op9_urls": _urls_sql()}
