"""The queries opN_<name>: each applies its operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, bpe, html_text, langid, merkle, packing, pii, quality, sampling, simhash, substring, token_store, topk
from tidemark.llm.common import new_path, written
from tidemark.sources.shared import ship


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *[f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_store.checksums(spark, path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(docs, pii.fit(docs))


def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.segmentations(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), packed=True)
    return found.withColumnRenamed("row_key", "doc_id")


def op4_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), langid.fit_text(table(spark, sf_dir, "documents")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = written(found.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links", "times"), "alignment")
    return alignment.scored(aligned, alignment.link_counts(aligned)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = {"text": F.translate("text", upper, lower)}
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", tampered, fifth)
    return merkle.verified(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sampled_pieces": op1_sampled_pieces,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_text": op3_html_text,
    "op4_page_language": op4_page_language,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_store": op6_token_store,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_topk": op10_topk,
    "op11_token_alignment": op11_token_alignment,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

#: A field of a manifest's leaf.
_FIELD = "(case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0}::varchar end)"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
pos as (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w),
win as (select doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) as k from pos),
again as (select doc_id, i from win qualify count(*) over (partition by k) > 1),
gone as (select distinct doc_id, i + o as j from again, range(35) t(o)),
cut as (select doc_id, list(j) as js, count(*) as c from gone group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(c, 0)::bigint as n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, j: js is null or not list_contains(js, j)), ' ')) as kept_sha256
from w left join cut using (doc_id)
""",
    "op5_quality_rules": rf"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), m as (
  select doc_id, ws, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(regexp_extract_all(text, '!'))::bigint as n_exclaimed,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    len(list_filter(ws, lambda x: lower(x) in ({_STOP})))::bigint as n_stop_words
  from w
), pos as (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from m),
win as (select doc_id, i, array_to_string(ws[i:i+7], ' ') as k from pos),
again as (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1),
covered as (select doc_id, count(distinct i + o)::bigint as c from again, range(8) t(o) group by doc_id),
b as (
  select doc_id, n_words, word_chars, n_symbols, n_exclaimed, n_stop_words, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, length(array_to_string(lines, '')) as line_chars,
    length(array_to_string(lines, '')) - length(array_to_string(list_distinct(lines), '')) as dup_line_chars, coalesce(c, 0) as n_repeat_words
  from m left join covered using (doc_id)
), f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * word_chars >= 200 * n_words and 100 * word_chars <= 2000 * n_words and 100 * n_symbols <= 10 * n_words
  and 100 * n_exclaimed <= 50 * n_words and 100 * n_stop_words >= 2 * n_words and 100 * n_dup_lines <= 30 * greatest(n_lines, 10)
  and 100 * dup_line_chars <= 20 * line_chars as kept
from f
""",
    "op10_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score
from s qualify rank <= 10
""",
    # `nodes` are the trees of the sources, `tops` the tree over them; `steps` and `ends` fold each leaf up both
    "op13_merkle_manifest": rf"""
with recursive docs as (
  select row_number() over () as id, doc_id, coalesce('1' || source, '0') as g,
    {_FIELD.format("doc_id")} || {_FIELD.format("source")} || {_FIELD.format("lang")} || {_FIELD.format("n_chars")} as head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered,
    xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
      lambda a, b: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, xor(a, b)), 4294967295), 4294967295) as crc
  from documents
), hashed as (
  select id, doc_id, g, sha256(head || {_FIELD.format("text")}) as leaf, case when crc % 5 = 0 then sha256(head || {_FIELD.format("lowered")}) end as other from docs
), leaves as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from hashed
), nodes as (
  select 0 as lv, g, pos, n, leaf as h from leaves
  union all select lv + 1, g, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by lv, g, pos // 16, n
), tops as (
  select 0 as lv, g, row_number() over (order by g) - 1 as pos, count(*) over () as n, h from nodes where n = 1
  union all select lv + 1, min(g), pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by lv, pos // 16, n
), steps as (
  select id, g, 0 as lv, pos, n, coalesce(other, leaf) as acc from leaves
  union all select s.id, s.g, s.lv + 1, s.pos // 16, (s.n + 15) // 16, sha256(string_agg(case when x.pos = s.pos then s.acc else x.h end, '' order by x.pos))
  from steps s join nodes x on x.lv = s.lv and x.g = s.g and x.pos // 16 = s.pos // 16 where s.n > 1 group by s.id, s.g, s.lv, s.pos, s.n
), ends as (
  select s.id, 0 as lv, r.pos, r.n, s.acc from steps s join tops r on r.lv = 0 and r.g = s.g where s.n = 1
  union all select e.id, e.lv + 1, e.pos // 16, (e.n + 15) // 16, sha256(string_agg(case when x.pos = e.pos then e.acc else x.h end, '' order by x.pos))
  from ends e join tops x on x.lv = e.lv and x.pos // 16 = e.pos // 16 where e.n > 1 group by e.id, e.lv, e.pos, e.n
), siblings as (
  select s.id, 0 as tree, s.lv, x.pos, x.h from steps s join nodes x on x.lv = s.lv and x.g = s.g and x.pos // 16 = s.pos // 16 and x.pos <> s.pos where s.n > 1
  union all select e.id, 1, e.lv, x.pos, x.h from ends e join tops x on x.lv = e.lv and x.pos // 16 = e.pos // 16 and x.pos <> e.pos where e.n > 1
), proofs as (select id, sha256(string_agg(h, '' order by tree, lv, pos)) as proof_sha256 from siblings group by id)
select doc_id, leaf, t.h as subroot, r.h as root, coalesce(proof_sha256, sha256('')) as proof_sha256, e.acc as folded_root, e.acc = r.h as verified
from leaves l join (select g, h from nodes where n = 1) t using (g) cross join (select h from tops where n = 1) r
join (select id, acc from ends where n = 1) e using (id) left join proofs using (id)
""",
}
