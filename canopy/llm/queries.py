"""Each operator over its whole table, as the driver runs it."""

from __future__ import annotations

from canopy.llm import decontaminate, linededup, minhash, packing, pii, pivots, quality, secrets, toxicity, warc
from canopy.llm.common import read_table


def op1_toxicity_chain(spark, sf_dir):
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_capture_index(spark, sf_dir):
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op4_semi_markov_pii(spark, sf_dir):
    return pii.find(read_table(spark, sf_dir, "documents"))


def op5_winnowed_line_dedup(spark, sf_dir):
    return linededup.remove_repeats(read_table(spark, sf_dir, "documents"), report=True)


def op6_site_quality(spark, sf_dir):
    """Documents have no URL: the source is the host, and the language within it the path."""
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, read_table(spark, sf_dir, "labels"), docs["source"], docs["lang"])


def op7_pivot_permutation(spark, sf_dir):
    return pivots.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_randomness_battery(spark, sf_dir):
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op9_seeded_alignment(spark, sf_dir):
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_minhash_forest(spark, sf_dir):
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def queries():
    return {f.__name__: f for f in (op1_toxicity_chain, op2_capture_index, op3_best_fit_packing, op4_semi_markov_pii, op5_winnowed_line_dedup, op6_site_quality, op7_pivot_permutation, op8_randomness_battery, op9_seeded_alignment, op10_minhash_forest)}


#: Records of equal payloads: the largest page_id is the response. Base32 takes the digest's bits in fives.
_WARC_SQL = """
with p as (
  select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), r as (
  select p.*, cast(octet_length(encode(html)) as bigint) as payload_bytes, max(page_id) over (partition by hex) as last,
         cast(cast(unhex(hex) as bit) as varchar) as bits from p
)
select page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1
         + 16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int)
         + 4 * cast(substr(bits, 5 * i + 3, 1) as int) + 2 * cast(substr(bits, 5 * i + 4, 1) as int)
         + cast(substr(bits, 5 * i + 5, 1) as int) as bigint), 1)), 'string_agg', '') as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type,
       case when page_id = last then null else last end as refers_to,
       url
from r
"""


#: Brute force: every pair of vectors, and what is reachable by links.
_PIVOTS_SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as x, len(embedding) as n from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), u as (
  select vec_id, x, n, sqrt(list_dot_product(x, x)) as size from v where list_dot_product(x, x) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.n = b.n and a.vec_id <> b.vec_id
  where list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.9
), reach as (
  select vec_id as id, vec_id as root from embeddings union select l.b, r.root from reach r join link l on l.a = r.id
)
select e.vec_id, (select count(*) from link where a = e.vec_id) as n_links, r.root as component_id, r.root = e.vec_id as kept
from embeddings e join (select id, min(root) as root from reach group by id) r on r.id = e.vec_id
"""

#: Brute force: every pair of documents that share a shingle, and what is reachable by links.
_MINHASH_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case
    when len(w) >= 5 then list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), link as (
  select a, b from (
    select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
  ) join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), reach as (
  select doc_id as id, doc_id as root from documents union select l.b, r.root from reach r join link l on l.a = r.id
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.root as component_id, r.root = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id join (select id, min(root) as root from reach group by id) r on r.id = d.doc_id
"""


def oracle_sql():
    return {"op2_capture_index": _WARC_SQL, "op7_pivot_permutation": _PIVOTS_SQL, "op10_minhash_forest": _MINHASH_SQL}
