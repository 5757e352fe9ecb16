"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from pitlane.llm import (bag_minhash, bit_sliced, decontaminate, hard_negatives, line_dedup, main_text, merkle, prefix_bpe, quality, repeats,
                         shards, token_counts, token_files)
from pitlane.llm.common import query, table
from pitlane.llm.libraries import vocabulary
from pitlane.session import scratch_path


@query("op2_prefix_bpe")
def op2(spark, sf_dir):
    """Every whole text encoded by prefix dynamic programming and decoded from its ids: counts and digests."""
    return prefix_bpe.encoded_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"),
                                      public_tokenizers.PATTERN)


@query("op8_token_files")
def op8(spark, sf_dir):
    """Token ids written to flat files in order of doc_id, and read back from them."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, f"llm-token-files-{uuid.uuid4().hex}")
    token_files.write_token_files(docs, folder, vocabulary("byte_bpe_50k.json"), end_id=0)
    back = token_files.read_token_files(spark, folder, docs.schema["doc_id"])
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_token_counts")
def op10(spark, sf_dir):
    """Bytes and tokens of every whole text."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


@query("op5_rendezvous_shards")
def op5(spark, sf_dir):
    """Every document in one of 40 shards by rendezvous hashing (law: key), and with a 41st."""
    docs = shards.assign(table(spark, sf_dir, "documents"), [1.0] * 40)
    return docs.withColumn("law", F.lit("key"))


@query("op7_suffix_automaton")
def op7(spark, sf_dir):
    """Benchmark items whose ten-word windows occur in each document."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_compression_quality")
def op4(spark, sf_dir):
    """Quality score of every whole text from compressed sizes."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_main_text")
def op9(spark, sf_dir):
    """Main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query("op1_bit_sliced_search", sql="""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint score
           from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5""")
def op1(spark, sf_dir):
    """Five best rows by integer inner product for every 50th vector, from the bit-sliced index."""
    vectors = table(spark, sf_dir, "embeddings")
    return bit_sliced.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query("op3_bag_minhash")
def op3(spark, sf_dir):
    """The near-duplicate class of every document (smallest doc_id in it)."""
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_radix_repeats")
def op6(spark, sf_dir):
    """Every document without bytes covered by 50-byte strings that start in a smaller document too."""
    return repeats.report(table(spark, sf_dir, "documents"), length=50)


@query("op11_merkle_manifest", sql="""
with recursive fields as (
  select row_number() over () as rid, doc_id, coalesce('=' || lang, '') as g,
         xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint), lambda crc, byte: list_reduce(
             range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, xor(crc, byte)), 4294967295), 4294967295) % 3 = 0 as hit,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
         coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
         coalesce(strlen(text) || ':' || text, '-') as body,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') as lowered
  from documents),
leaves as (
  select rid, doc_id, g, sha256(head || body) as leaf, sha256(head || case when hit then lowered else body end) as tampered from fields),
placed as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from leaves),
tree as (
  select g, 0 as l, pos, n, leaf as node from placed
  union all
  select g, l + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' order by pos)) from tree where n > 1 group by g, l, pos // 8, (n + 7) // 8),
subroots as (
  select g, node, row_number() over (order by g) - 1 as pos, count(*) over () as n from tree where n = 1),
top as (
  select 0 as l, pos, n, node from subroots
  union all
  select l + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' order by pos)) from top where n > 1 group by l, pos // 8, (n + 7) // 8),
runs as (select g, l, pos // 8 as run, list(node order by pos) as nodes from tree where n > 1 group by g, l, pos // 8),
top_runs as (select l, pos // 8 as run, list(node order by pos) as nodes from top where n > 1 group by l, pos // 8),
fold as (
  select rid, g, 0 as l, pos, tampered as node, '' as others from placed
  union all
  select f.rid, f.g, f.l + 1, f.pos // 8, sha256(array_to_string(r.nodes[:f.pos % 8] || [f.node] || r.nodes[f.pos % 8 + 2:], '')),
         f.others || array_to_string(r.nodes[:f.pos % 8] || r.nodes[f.pos % 8 + 2:], '')
  from fold f join runs r on r.g = f.g and r.l = f.l and r.run = f.pos // 8),
folded as (select rid, arg_max(node, l) as node, arg_max(others, l) as others from fold group by rid),
fold_top as (
  select f.rid, 0 as l, s.pos, f.node, f.others from folded f join placed p on p.rid = f.rid join subroots s on s.g = p.g
  union all
  select f.rid, f.l + 1, f.pos // 8, sha256(array_to_string(r.nodes[:f.pos % 8] || [f.node] || r.nodes[f.pos % 8 + 2:], '')),
         f.others || array_to_string(r.nodes[:f.pos % 8] || r.nodes[f.pos % 8 + 2:], '')
  from fold_top f join top_runs r on r.l = f.l and r.run = f.pos // 8),
ends as (select rid, arg_max(node, l) as folded_root, arg_max(others, l) as others from fold_top group by rid)
select p.doc_id, p.leaf, s.node as subroot, t.node as root, sha256(e.others) as proof_sha256, e.folded_root, e.folded_root = t.node as verified
from placed p join ends e on e.rid = p.rid join subroots s on s.g = p.g join top t on t.n = 1""")
def op11(spark, sf_dir):
    """Every document's leaf, proof and root by bitmap ranks, and whether a tampered third still folds to the root."""
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"])


@query("op12_hard_negatives", sql="""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select row_number() over () as aid, * from v where vec_id % 100 = 0),
scored as (select a.aid, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
                  coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
           from a join v c on c.vec_id <> a.vec_id and len(a.v) = len(c.v)),
positives as (select *, row_number() over (partition by aid order by score desc, vec_id) as place from scored where same qualify place <= 5),
ranked as (select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.aid, p.place order by n.score desc, n.vec_id)::integer as rank,
                  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
           from positives p join scored n on n.aid = p.aid and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select * from ranked where rank <= 10""")
def op12(spark, sf_dir):
    """Rows of other labels that score next below the nearest of an anchor's own label, from rotated one-bit codes."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op13_line_dedup", sql="""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as body from documents),
lines as (select rid, doc_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as pos from d),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
often as (select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k
          having count(distinct doc_id) + max((doc_id is null)::int) >= 5),
marked as (select m.*, o.k is not null and m.doc_id is distinct from o.keeper as gone from keyed m left join often o on m.k = o.k)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by rid""")
def op13(spark, sf_dir):
    """Every document without the long lines that five documents or more hold, but for the last of these."""
    return line_dedup.report(table(spark, sf_dir, "documents"))
