"""The registered queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_chunks, chat_format, decontaminate, hard_negatives, jaccard_join, merkle_manifest, neighbour_quality, paragraph_dedup, quality_ratio, secret_scan, sst_output, toxicity, url_filter
from .common import table


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies on this machine; every machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst_output.token_shards(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ratio.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_chunks.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.chat_digests(rows.unionByName(extra), tokenizer_file("byte_bpe_50k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op11_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neighbour_quality.quality_scores(docs, neighbour_quality.train(docs, table(spark, sf_dir, "labels")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.merkle_proofs(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sst_shards, op2_secret_scan, op3_url_filter, op4_paragraph_dedup, op5_decontaminate, op6_quality_ratio, op7_bpe_chunks, op8_toxicity, op9_chat_format, op10_jaccard_join, op11_neighbour_quality, op12_merkle_manifest, op13_hard_negatives)}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_LEVEL = """l{k} as (select ctx, c, sum(a) as na, sum(r) as nr from (select substr(gram, {at}, {k}) as ctx, substr(gram, 4, 1) as c, a, r from cnt) group by 1, 2),
s{k} as (select ctx, sum(na) as ta, sum(nr) as tr, sum((na > 0)::int) as da, sum((nr > 0)::int) as dr from l{k} group by 1 having sum(na) + sum(nr) >= 8),
m{k} as (select gram, case when ta > 0 then (na + da * pa) / (ta + da) else pa end as pa, case when tr > 0 then (nr + dr * pr) / (tr + dr) else pr end as pr
 from m{before} m left join l{k} l on l.ctx = substr(gram, {at}, {k}) and l.c = substr(gram, 4, 1) left join s{k} s on s.ctx = substr(gram, {at}, {k}))"""

_OP3 = (
    r"""
with p as (select row_number() over () as rid, page_id, coalesce(url, '') as u from pages),
h as (select *, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
 '^^^' || regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0./\-_:?=&#%]', '~', 'g') || '$' as s, substr(md5(u), 1, 1) < '3' as held from p),
rl(what, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b as (select h.*, rule, ruled from h left join (select rid, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(what, length(rh || rp)) as ruled from h, rl where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1) using (rid)),
g as (select rid, ruled, held, substr(s, i, 4) as gram from b, unnest(generate_series(1, length(s) - 3)) t(i)),
cnt as (select gram, sum((coalesce(ruled = 'allow', false) and not held)::int) as a, sum((coalesce(ruled = 'block', false) and not held)::int) as r from g group by 1),
m as (select gram, 1e0 / 39 as pa, 1e0 / 39 as pr from cnt),
"""
    + ",\n".join(_LEVEL.format(k=k, at=4 - k, before=k - 1 if k else "") for k in range(4))
    + """,
two as (select sum(a) > 0 and sum(r) > 0 as two from cnt),
sc as (select gram, case when two then ln(pa) - ln(pr) else 0e0 end as llr from m3, two),
ll as (select b.*, l.llr from b join (select rid, round(avg(llr), 6) as llr from g join sc using (gram) group by 1) l using (rid)),
bins as (select greatest(-1000, least(1000, floor(llr * 100)))::bigint as b, sum((ruled = 'allow')::int) as g, sum((ruled <> 'allow')::int) as n from ll where held and ruled is not null group by 1),
sp as (select (b + 1) / 1e2 as cut, sum(g) over w as gb, sum(n) over w as nb, sum(g) over () as gt, sum(n) over () as nt from bins window w as (order by b rows unbounded preceding)),
best as (select coalesce((select cut from sp where gt > 0 and nt > 0 order by round(nb / nt - gb / gt, 9) desc, abs(cut), cut limit 1), 0e0) as cut)
select page_id, host, path, rule, coalesce(ruled, case when llr >= cut then 'allow' else 'block' end) as verdict, llr from ll, best
"""
)

ORACLE_SQL = {
    "op3_url_filter": _OP3,
    "op5_decontaminate": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as id, {_WORDS} as w from benchmark),
bw as (select distinct id, least(13, len(w)) as n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') as win
       from b, unnest(generate_series(1, greatest(1, len(w) - 12))) t(s) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select r, s, sizes.n, array_to_string(w[s : s + sizes.n - 1], ' ') as win
       from d, sizes, unnest(generate_series(1, len(w) - sizes.n + 1)) t(s) where len(w) >= sizes.n),
hit as (select distinct dw.r, dw.s, dw.n, bw.id from dw join bw on dw.n = bw.n and dw.win = bw.win),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(s, s + n - 1)) as p from hit) group by r),
an as (select distinct w, p, term from (select w, s, p, term, row_number() over (partition by w, s order by df, term, p) as k
       from (select w, p - 1 as p, w[p] as term, unnest(generate_series(greatest(0, p - 13), greatest(0, least(p - 1, len(w) - 13)))) as s from (select w, unnest(generate_series(1, len(w))) as p from (select distinct w from b where len(w) > 0)))
       join (select term, count(found) as df from (select distinct unnest(w) as term from b) left join (select unnest(w) as found from d) on term = found group by 1) using (term)) where k <= 2),
nr as (select r, count(*) as n_near from (select distinct r, w from (select r, w, blk, count(distinct p) as n from
       (select r, an.w, p, floor((pos - 1 - p) / 5e0) + o as blk from (select r, unnest(w) as term, unnest(generate_series(1, len(w))) as pos from d) join an using (term), (values (0), (1)) v(o)) group by 1, 2, 3) where n >= least(2, len(w))) group by 1),
its as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, id from hit) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(n_near, 0)::bigint as n_near
from d left join pos using (r) left join its using (r) left join nr using (r)""",
    "op12_merkle_manifest": """
with recursive x as (select *, unnest([0, 1]) as v from documents),
lf as (select doc_id, lang, v, sha256(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
 || coalesce(strlen((n_chars + v)::varchar) || ':' || (n_chars + v), '-') || coalesce(strlen(text) || ':' || text, '-')) as h from x),
le as (select a.doc_id, a.lang, a.h as leaf, b.h as changed, row_number() over (partition by a.lang order by a.doc_id) - 1 as i, count(*) over (partition by a.lang) as n from lf a join lf b on a.doc_id = b.doc_id and a.v = 0 and b.v = 1),
lv as (select lang, 0 as l, i, leaf as h, n from le union all select lang, l + 1, i // 2, sha256(string_agg(h, '' order by i)), (any_value(n) + 1) // 2 from lv where n > 1 group by lang, l, i // 2),
sr as (select lang, h, row_number() over (order by lang nulls first) - 1 as g, count(*) over () as m from lv where n = 1),
tp as (select 0 as l, g as i, h, m as n from sr union all select l + 1, i // 2, sha256(string_agg(h, '' order by i)), (any_value(n) + 1) // 2 from tp where n > 1 group by l, i // 2),
nd as (select g, l, i, lv.h, n from lv join sr using (lang) union all select -1, l, i, h, n from tp),
lc as (select doc_id, leaf, case when crc % 7 = 0 then changed else leaf end as f0, sr.h as subroot, g, i from (select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) as crc from le) join sr using (lang)),
up as (select doc_id, g as tree, g, 0 as l, i, f0 as f, '' as p, false as top from lc union all
 select u.doc_id, case when me.n = 1 then -1 else u.tree end, u.g, case when me.n = 1 then 0 else u.l + 1 end, case when me.n = 1 then u.g else u.i // 2 end,
 case when me.n = 1 then u.f when s.h is null then sha256(u.f) when u.i % 2 = 1 then sha256(s.h || u.f) else sha256(u.f || s.h) end, u.p || case when me.n = 1 then '' else coalesce(s.h, '') end, me.n = 1 and u.tree = -1
 from up u join nd me on me.g = u.tree and me.l = u.l and me.i = u.i left join nd s on s.g = u.tree and s.l = u.l and s.i = xor(u.i, 1) where not u.top)
select doc_id, leaf, subroot, (select h from tp where n = 1) as root, sha256(p) as proof_sha256, f as folded_root, f = (select h from tp where n = 1) as verified from up join lc using (doc_id) where top""",
    "op13_hard_negatives": """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
 from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, list_dot_product(a.v, r.v)::bigint as score from e a join e r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score qualify rank <= 10""",
}
