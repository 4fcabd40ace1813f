"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, fingerprints, infill, langid, minhash, mixing, packing, sharding, tokencount, toxicity, warc
from .common import table

SHARDS = 40
MIX_POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
MIX_SHARE = 0.6


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fold(n: int, column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def mixed(docs: DataFrame, share: float = MIX_SHARE) -> DataFrame:
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.register(F.col("text"))}
    return mixing.mix(docs, dims, mixing.words(F.col("text")), MIX_POWERS, share, F.col("doc_id"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"), F.col("mix_keep").alias("sampled"))


def _ipf_sql(sweeps: int = 18, rounds: int = 8) -> str:
    """The same raking and calibration as SQL, a step a common table expression."""
    steps = [
        """docs as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
  case when text is null or text = '' then 'empty'
       when length(regexp_replace(text, '[^|]', '', 'g')) * 100 >= length(text) then 'table'
       when length(regexp_replace(text, '[^A-Z]', '', 'g')) * 2 >= length(text) then 'shouting'
       when length(regexp_replace(text, '[^0-9]', '', 'g')) * 10 >= length(text) then 'figures'
       when length(text) < 600 then 'brief' when length(text) < 4000 then 'article' else 'long' end as topic,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) as tokens from documents)""",
        "cells as (select source, lang, topic, sum(tokens)::bigint as tokens from docs group by all)",
    ]
    for d, p in MIX_POWERS.items():
        steps.append(f"t_{d} as (select {d}, pow(sum(tokens)::double, {p}) as t_{d} from cells group by all having sum(tokens) > 0)")
    steps.append("w0 as (select *, case when tokens > 0 then tokens::double else 0 end as w from cells left join t_source using (source) left join t_lang using (lang) left join t_topic using (topic))")
    k = 0
    for _ in range(sweeps):
        for d in MIX_POWERS:
            steps.append(f"w{k + 1} as materialized (select * replace (case when sum(w) over (partition by {d}) > 0 then w * t_{d} / sum(w) over (partition by {d}) else 0 end as w) from w{k})")
            k += 1
    steps.append(f"p0 as (select source, lang, topic, tokens, w / sum(w) over () as w, 0.0::double as p, {MIX_SHARE} * sum(tokens) over () as budget from w{k})")
    for r in range(rounds):
        steps.append(
            f"p{r + 1} as materialized (select * replace (case when p >= 1 then 1.0 when sum(case when p >= 1 then 0.0 else w end) over () > 0 and tokens > 0 "
            "then least(1.0, greatest(0.0, budget - sum(case when p >= 1 then tokens else 0 end) over ()) * w / sum(case when p >= 1 then 0.0 else w end) over () / tokens) "
            f"else 0.0 end as p) from p{r})"
        )
    return (
        "with " + ",\n".join(steps) + f"\nselect doc_id, round(w, 6) as weight, round(p, 6) as probability, "
        f"('0x' || substr(md5('mix:' || doc_id), 1, 13))::bigint::double / 4503599627370496.0 < p as sampled from docs join p{rounds} using (source, lang, topic)"
    )


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, labels.where(fold(5) != 0))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).drop("text")


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.where(fold(4) != 2))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str, bits: int = 5) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dims = [sharding.by_hash("lang", bits), sharding.by_hash("source", bits), sharding.by_quantile(docs, "n_chars", bits)]
    out = sharding.shard(docs, dims, bits, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json"))).withColumnRenamed("id", "doc_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("payload")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, packed=True).drop("text")
    out = bpe.decode(ids, path)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flags = labels.select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    counts = audit.counted(docs, F.col("doc_id"), F.col("text"), F.col("lang"), audit.text_filters(F.col("text")), flags, copies="E")
    out = audit.steps(counts, "ABCDE", ["good", "toxic"])
    return out.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash, op2_mixing, op3_toxicity, op4_fingerprints, op5_neighbours, op6_tokencount, op7_langid, op8_sharding, op9_packing, op10_warc, op11_bpe, op12_filters, op13_infill)}

ORACLE = {
    "op2_mixing": _ipf_sql(),
    "op5_neighbours": """with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null),
n as (select vec_id, e, sqrt(list_inner_product(e, e)) as norm from v),
s as (select q.vec_id as query_id, n.vec_id, list_inner_product(q.e, n.e) / (q.norm * n.norm) as score from n join n q on q.vec_id % 50 = 0 and q.vec_id <> n.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify rank <= 5""",
    "op12_filters": """with recursive d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, max(coalesce(quality, 0) = 1) as good, max(coalesce(toxic, 0) = 1) as toxic from labels group by 1),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
  (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::int
  + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask from d left join l using (doc_id)),
c as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
o as (select '' as filter_order, 0 as bits union all select filter_order || x, bits + b from o, (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b) where bits & b = 0),
s as (select filter_order, step::int as step, 1 << (ascii(filter_order[step]) - 65) as bit,
  list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65)))::int as had from (select filter_order, unnest(range(1, 6)) as step from o where bits = 31)),
r as (select part, filter_order, step, bit, sum(n) filter (mask & (coalesce(had, 0) | bit) = 0) as kept, sum(n) filter (mask & bit > 0 and mask & coalesce(had, 0) = 0) as removed,
  sum(n) filter (mask & bit > 0 and mask & coalesce(had, 0) > 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
  sum(good) filter (mask & bit > 0 and mask & coalesce(had, 0) = 0) as good_lost, sum(toxic) filter (mask & bit > 0 and mask & coalesce(had, 0) = 0) as toxic_lost
  from s, c group by part, filter_order, step, bit)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, sum(coalesce(removed, 0)) over (partition by part, bit)::bigint as shapley from r""",
    "op13_infill": """with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
g as (select *, len(t) as n, ('0x' || h[1:8])::bigint % (len(t) + 1) as a, ('0x' || h[9:16])::bigint % (len(t) + 1) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain' when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form from d),
p as (select *, array_to_string(t[1:least(a, b)], '') as x, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') as y, array_to_string(t[greatest(a, b) + 1:n], '') as z from g)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(x) end::bigint as prefix_chars, case when form <> 'plain' then length(y) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256, sha256(text) as restored_sha256 from p""",
}
