"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flipside.llm.chosen_path import jaccard_classes
from flipside.llm.common import table
from flipside.llm.exact_dedup import exact_dedup
from flipside.llm.interpolated_lm import score_documents
from flipside.llm.itq_dedup import near_vectors
from flipside.llm.kd_sharding import kd_shards
from flipside.llm.kernel_quality import score_quality
from flipside.llm.learned_partitions import nearest
from flipside.llm.mixing import mix_totals
from flipside.llm.pow2_packing import pack_pow2
from flipside.llm.rns_negatives import hard_negatives
from flipside.llm.secret_ledger import BASE_KINDS, scan_secrets
from flipside.llm.spill_alignment import align_documents
from flipside.llm.url_rules import ListRule, MiningConfig, judge_urls

URL_RULES = (
    ListRule("allow", "org", "/"),
    ListRule("block", "example.org", "/es/"),
    ListRule("block", "example.org", "/en/1"),
    ListRule("allow", "com", "/fr/"),
    ListRule("block", "com", "/de/"),
)


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_pow2(table(spark, sf_dir, "documents"), word_tokenizer())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("text_hash", "class_key")


def op6_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return out.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_totals(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def moved_label() -> Column:
    """The label of a row; every seventh vec_id counts for the next class."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op11_rns_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved_label())


def op12_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_spill_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_learned_partitions, op2_deleted_interpolation, op3_kd_sharding, op4_pow2_packing, op5_chosen_path_join, op6_kernel_quality, op7_secret_ledger, op8_sainte_lague_mixing, op9_exact_dedup, op10_url_rules, op11_rns_negatives, op12_itq_dedup, op13_spill_alignment)}

# Disjoint or nested rules, the longest text first.
_RULE_CASES = [
    (f"(host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}')", r) for r in sorted(URL_RULES, key=lambda r: -len(r.text))
]

# The frequent token sets by listing every subset of at most six tokens.
_URL_SQL = f"""
with u as (select page_id, url, case when coalesce(position('://' in url), 0) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages),
h as (select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
p as (select *, case {' '.join(f"when {c} then '{r.text}'" for c, r in _RULE_CASES)} end as rule, case {' '.join(f"when {c} then '{r.verdict}'" for c, r in _RULE_CASES)} end as listed,
  string_split(host, '.') as l, list_filter(string_split(path, '/'), lambda x: x <> '') as d, regexp_extract(path, '/(\\d)\\d*[^/]*/?$', 1) as g,
  case when contains(url, '?') then '?' || regexp_extract(regexp_extract(url, '[?#](.*)$', 1), '^([A-Za-z_]*)', 1) when contains(url, '#') then '#' when path like '%/' then '/' else regexp_extract(path, '(\\.[A-Za-z]+)$', 1) end as e from h),
t as (select page_id, host, path, rule, listed,
  list_sort(list_distinct(list_filter([case when host <> '' then 'site:' || array_to_string(l[greatest(len(l) - 1, 1):len(l)], '.') end, case when len(l) >= 3 then 'name:' || l[len(l) - 2] end,
  case when len(l) >= 4 then 'sub:' || l[1] end, case when len(d) >= 1 then 'dir:' || d[1] end, case when g <> '' then 'digit:' || g end, case when e <> '' then 'end:' || e end], lambda x: x is not null))) as tokens from p),
s as (select tokens, count(*) filter (rule is not null) as n, count(*) filter (listed = 'block') as b from t where len(tokens) > 0 group by tokens),
least as (select greatest({MiningConfig().min_count}, ceil({MiningConfig().min_support}::double * sum(b))) as c from s),
m as (select tokens, n, b, unnest(range(1, (1 << len(tokens))::bigint)) as mask from s),
a as (select tokens, n, b, list_filter(tokens, lambda x, i: (mask >> (i - 1)) % 2 = 1) as ante from m),
r as (select ante, sum(b) as uses, sum(b)::double / sum(n) as confidence from a group by ante having sum(b) >= (select c from least) and sum(b)::double / sum(n) >= {MiningConfig().min_confidence}::double),
k as (select a.tokens, arg_min(array_to_string(ante, ' '), (-confidence, -uses, len(ante), array_to_string(ante, ' '))) as mined_rule from a join r using (ante) group by a.tokens)
select page_id, host, path, rule, coalesce(listed, case when mined_rule is not null then 'block' else 'allow' end) as verdict, case when rule is null then mined_rule end as mined_rule
from t left join k using (tokens)"""

ORACLES = {
    "op9_exact_dedup": """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from d group by norm)
select d.doc_id, g.keep_id, g.group_size,
       (d.doc_id is not distinct from g.keep_id) and row_number() over (partition by d.norm, d.doc_id) = 1 as kept,
       sha256(d.norm) as text_sha256
from d join g using (norm)""",
    "op10_url_rules": _URL_SQL,
    "op11_rns_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as lab, list_transform(embedding, lambda a: floor(256 * a::double)) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda a: a is null or not isfinite(a))) = 0),
s as (select a.vec_id as anchor_id, r.vec_id, r.lab = a.lab as same, list_inner_product(a.q, r.q)::bigint as score
  from v a join v r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op12_itq_dedup": """
with recursive v as (select row_number() over () as n, vec_id, label, embedding::double[] as x from embeddings),
ok as (select *, sqrt(list_inner_product(x, x)) as len from v
  where label is not null and x is not null and len(list_filter(x, lambda a: a is null or not isfinite(a))) = 0 and len(list_filter(x, lambda a: a <> 0)) > 0),
links as (select a.n as i, b.n as j from ok a join ok b on a.label = b.label and len(a.x) = len(b.x) and a.n <> b.n
  where list_inner_product(a.x, b.x) / (a.len * b.len) >= 0.98::double),
reach as (select n as i, n as j from v union select r.i, l.j from reach r join links l on r.j = l.i),
c as (select r.i, min(v.vec_id) as component_id from reach r join v on v.n = r.j group by r.i),
k as (select i, count(*) as n_links from links group by i)
select v.vec_id, coalesce(k.n_links, 0)::bigint as n_links, c.component_id, v.vec_id is not distinct from c.component_id as kept
from v join c on c.i = v.n left join k on k.i = v.n""",
}
