"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _op1_sql() -> str:
    """The tree's draws written out level by level; crc32 as a fold over half bytes with its 16-entry table."""
    def cost(name, weight):
        bits = f"cast('0x' || substr(md5(k || ':{name}'), 1, 13) as bigint)"
        return f"{{'c': -ln((cast({bits} as double) + 0.5) / 4503599627370496.0) / {weight}, 'n': '{name}'}}"

    def tree(regions):
        level = [f"list_min([{', '.join(cost(f'g{g}', w) if g < 3 else cost('x24', w) for g, w in regions)}]).n"]
        rack = " ".join(f"when 'g{g}' then list_min([{cost(f'g{g}/r0', 4.0)}, {cost(f'g{g}/r1', 4.0)}]).n" for g in range(3))
        leaf = " ".join(f"when 'g{g}/r{r}' then list_min([{', '.join(cost(f'g{g}/r{r}/{8 * g + 4 * r + i}', 1.0) for i in range(4))}]).n"
                        for g in range(3) for r in range(2))
        return level[0], rack, leaf

    out = []
    for name, regions in (("shard", [(g, 8.0) for g in range(3)]), ("grown_shard", [(g, 8.0) for g in range(3)] + [(3, 1.0)])):
        region, rack, leaf = tree(regions)
        out.append((name, region, rack, leaf))
    (_, r1, k1, l1), (_, r2, k2, l2) = out
    return f"""
with docs as (select doc_id, text, coalesce(cast(doc_id as varchar), '') as k from documents),
nibbles as (select doc_id, k, text, octet_length(encode(text)) as n, hex(encode(text)) as h from docs),
folded as (select doc_id, k, coalesce(n, 0) + 8 as size, case when text is null then null when n = 0 then 0 else
  xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(regexp_replace(h, '(.)(.)', '\\2\\1', 'g'), ''),
      lambda x: [cast(strpos('0123456789ABCDEF', x) - 1 as bigint)]))),
    lambda a, b: xor(a >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::bigint[])[1 + (xor(a, b) & 15)])),
    4294967295::bigint) end as crc from nibbles),
regions as (select *, {r1} as ga, {r2} as gb from folded),
racks as (select *, case ga {k1} end as ra, case gb {k2} else 'x24/r0' end as rb from regions),
leaves as (select *, case ra {l1} end as la, case rb {l2} else 'x24/r0/24' end as lb from racks),
placed as (select doc_id, cast(size as bigint) as size, crc as text_crc32, cast(split_part(la, '/', 3) as integer) as shard,
  cast(split_part(lb, '/', 3) as integer) as grown_shard,
  substr(md5(k || ':' || size || ':' || coalesce(cast(crc as varchar), '')), 1, 3) as bucket from leaves)
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by bucket, doc_id nulls first, size, text_crc32 nulls first) - 1 as slot, grown_shard
from placed"""


@register("op1_sharding", _op1_sql())
def op1_sharding(spark, sf_dir):
    from .sharding import shard
    return shard(table(spark, sf_dir, "documents"), shards=24, grown=25)


#: The hand-written rules of the contract: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@register("op3_url_filters")
def op3_url_filters(spark, sf_dir):
    from .url_filters import filter_urls, hand_rule, host_path
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    # a URL that a hand-written rule judges is labelled by it, any other by the label of its page
    labelled = pages.join(labels, pages.page_id == labels.doc_id, "left").withColumn(
        "ruled", hand_rule(*host_path(F.col("url")), URL_RULES)[1])
    labelled = labelled.select("url", F.coalesce(F.col("ruled") == "block", "bad").alias("blocked"))
    return filter_urls(pages, labelled, URL_RULES)


@register("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark, sf_dir):
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)


@register("op6_approximate_nearest_neighbours")
def op6_approximate_nearest_neighbours(spark, sf_dir):
    from .ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op9_language_id")
def op9_language_id(spark, sf_dir):
    from .langid import fit, identify
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    return identify(docs, model).withColumn("held_out", id_remainder(F.col("doc_id"), 3) == 1)


def toxicity_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the documents that the toxicity network may learn from."""
    known = labels.where(F.col("toxic").isNotNull() & (id_remainder(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").where(F.char_length("text") <= _train_chars()).join(known, "doc_id")


def _train_chars() -> int:
    from .toxicity import TRAIN_CHARS
    return TRAIN_CHARS


@register("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    from .toxicity import fit, rate
    docs = table(spark, sf_dir, "documents")
    model = fit(toxicity_labels(docs, table(spark, sf_dir, "labels")))
    return rate(docs, model).withColumn("held_out", id_remainder(F.col("doc_id"), 4) == 2)


@register("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark, sf_dir):
    from .decontaminate import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op5_sentencepiece")
def op5_sentencepiece(spark, sf_dir):
    from .sentencepiece_codec import encode
    return encode(table(spark, sf_dir, "documents"))


@register("op8_license_scans")
def op8_license_scans(spark, sf_dir):
    from .licences import scan
    return scan(table(spark, sf_dir, "documents"))


@register("op10_lm_scoring")
def op10_lm_scoring(spark, sf_dir):
    from .lm_scores import cross_entropy_difference
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


_OP11_SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct r, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) end) as g from d),
n as (select r, count(*) as n from s group by r),
p as (select a.r as a, b.r as b, count(*) as m from s a join s b on a.g = b.g and a.r < b.r group by all),
l as (select p.a, p.b from p join n x on x.r = p.a join n y on y.r = p.b where 100 * p.m >= 85 * (x.n + y.n - p.m)),
e as (select a, b from l union all select b, a from l),
reach as (select r as a, r as b from d union select reach.a, e.b from reach join e on e.a = reach.b),
c as (select reach.a as r, min(d.doc_id) as component_id from reach join d on d.r = reach.b group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from d left join n using (r) join c using (r)"""


@register("op11_ngram_jaccard_join", _OP11_SQL)
def op11_ngram_jaccard_join(spark, sf_dir):
    from .jaccard_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")


def _op12_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds written out, every centroid compared."""
    def nearest(name, centroids):
        return f"""
{name} as (select v.vec_id, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'k': c.k}}) as m
  from v, {centroids} c group by v.vec_id, v.x)"""

    def means(name, assigned, before):
        return f"""
{name}s as (select k, i, sum(e)::hugeint as s, count(*) as n from (
    select m.k as k, unnest(x) as e, generate_subscripts(x, 1) as i from {assigned}) group by k, i),
{name} as (select b.k, coalesce(c.x, b.x) as x from {before} b left join (
    select k, list(cast((s - (((s % n) + n) % n)) // n as bigint) order by i) as x from {name}s group by k) c on c.k = b.k)"""

    steps, now = [], "c0"
    for r in range(1, rounds + 1):
        steps += [nearest(f"a{r}", now), means(f"c{r}", f"a{r}", now)]
        now = f"c{r}"
    return f"""
with v as (select vec_id, list_transform(embedding, lambda e: cast(floor(64 * cast(e as double)) as bigint)) as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, x from v order by sha256('1:' || vec_id) limit {clusters}),
{",".join(steps)},{nearest("z", now)},
i as (select m.k as k, cast(sum(m.d) as bigint) as inertia from z group by 1)
select z.vec_id, cast(z.m.k as integer) as cluster, cast(z.m.d as bigint) as distance, i.inertia as cluster_inertia,
  cast((select sum(inertia) from i) as bigint) as inertia,
  sha256(array_to_string(list_transform(c.x, lambda e: cast(e as varchar)), ',')) as centroid_sha256
from z join i on i.k = z.m.k join {now} c on c.k = z.m.k"""


@register("op12_centroid_clustering", _op12_sql())
def op12_centroid_clustering(spark, sf_dir):
    from .centroids import cluster
    return cluster(table(spark, sf_dir, "embeddings"))


_OP13_SQL = r"""
with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= 3),
c as (select w.lang, w.source, w.term, count(*) as n from w join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from kept group by lang),
t as (select g.lang, g.source, coalesce(sum(c.n), 0) as total from g left join c using (lang, source) group by all),
p as (select t.lang, t.source, kept.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (t.total + v.v)::hugeint as p
  from t join v using (lang) join kept using (lang) left join c on c.lang = t.lang and c.source = t.source and c.term = kept.term),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 1)) // ((select sum(total) from t where t.lang = p.lang) + (select v from v where v.lang = p.lang))::hugeint as q
  from p group by lang, term),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
  on s.lang = a.lang and s.source = a.source and s.item = b.source),
tops as (select p.lang, p.source, p.term as item, (p.p - q.q) * (p.p - q.q) // q.q as value from p join q using (lang, term) where p.n > 0 and p.p > q.q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select * from (select lang, source, 'term' as part, item, value,
    row_number() over (partition by lang, source order by value desc, item) as rank from tops) where rank <= 200)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked"""


@register("op13_source_divergence_audit", _OP13_SQL)
def op13_source_divergence_audit(spark, sf_dir):
    from .divergence import audit
    return audit(table(spark, sf_dir, "documents"))
