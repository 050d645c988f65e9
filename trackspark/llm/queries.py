"""One registered query per operator, each over its whole table, and the SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import (
    bpe, collocations, hard_negatives, language_id, line_dedup, minhash, mixing, quality_rules, substring_dedup, topk, toxicity, url_filter, warc,
)
from trackspark.llm.text import crc_fold

VOCABULARY = "byte_bpe_50k.json"
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Shares of the mixture, by path in the tree; a path that is not named weighs 1.
WEIGHTS = {
    "prose": 3, "notes": 1,
    "prose/en": 4, "prose/fr": 2, "prose/de": 2, "prose/es": 2,
    "prose/en/src0": 2, "prose/fr/src0": 2, "prose/de/src0": 2, "prose/es/src0": 2,
}
SHARE, SEED = 0.6, 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def domain() -> Column:
    """Texts of at least 1,000 characters are prose, others notes."""
    return F.when(F.char_length("text") >= 1000, F.lit("prose")).otherwise(F.lit("notes"))


def held_out(folds: int, fold: int) -> Column:
    return crc_fold(F.col("doc_id"), folds) == fold


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picks = mixing.mix(docs, domain(), WEIGHTS, share=SHARE, seed=SEED)
    return picks.select(F.col("doc").alias("doc_id"), "domain", "lang", "source", "epoch", "tokens")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())
    return told.select(
        F.expr("try_cast(doc as bigint)").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return told.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return told.select("doc_id", "n_shingles", "component_id", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality_rules.judge(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels, held_out(5, 0)).select("doc_id", "held_out", "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), held_out(3, 1))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_mixing, op3_url_filter, op4_topk, op5_bpe, op6_line_dedup, op7_minhash, op8_quality_rules, op9_toxicity,
        op10_language_id, op11_substring_dedup, op12_hard_negatives, op13_collocations,
    )
}

_TERMS = {
    kind: " + ".join(f"(regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])'))::int" for term in terms)
    for kind, terms in (("strict", url_filter.STRICT), ("soft", url_filter.SOFT))
}
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL: dict[str, str] = {
    "op3_url_filter": f"""
with rules(verdict, host, path) as (values {', '.join(str(r) for r in RULES)}),
pages_ as (
  select page_id, translate(coalesce(url, ''), {_AZ}) as u,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {_AZ}) as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
fits as (
  select p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from pages_ p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  group by p.page_id),
hits as (select page_id, host, path, {_TERMS['strict']} as strict_hits, {_TERMS['soft']} as soft_hits from pages_)
select h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, case when strict_hits >= 1 or soft_hits >= 2 then 'block' else 'allow' end) as verdict,
  strict_hits::int as strict_hits, soft_hits::int as soft_hits
from hits h left join fits f using (page_id)""",
    "op4_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op6_line_dedup": f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) as key
  from lines),
shared as (select key, min(doc_id) as keeper from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
told as (select k.*, coalesce(s.keeper <> k.doc_id, false) as gone from keyed k left join shared s using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from told group by doc_id""",
    "op11_substring_dedup": r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (select doc_id, p, array_to_string(words[p:p + 49], ' ') as k from (select doc_id, words, unnest(range(1, len(words) - 48)) as p from texts)),
starts as (select k, min(doc_id) as smallest from windows group by k having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as p from windows join starts using (k) where smallest < doc_id),
words_ as (select doc_id, unnest(words) as w, generate_subscripts(words, 1) as p from texts),
kept as (
  select w.doc_id, count(g.p) as n_removed, string_agg(w.w, ' ' order by w.p) filter (g.p is null) as kept
  from words_ w left join gone g using (doc_id, p) group by w.doc_id)
select t.doc_id, len(t.words)::bigint as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from texts t left join kept k using (doc_id)""",
    "op12_hard_negatives": """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same) where place <= 5),
n as (
  select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id,
    positive_score, score as negative_score
  from p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from n where rank <= 10""",
    "op13_collocations": rf"""
with pieces as (
  select lang, words from (
    select lang, unnest(list_transform(string_split_regex(text, '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) as words
    from (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), {_AZ}) as text from documents))
  where len(words) > 0),
totals as (select lang, sum(len(words))::bigint as n from pieces group by lang),
grams as (
  select lang, size, array_to_string(words[p:p + size - 1], ' ') as phrase
  from (select lang, words, size, unnest(range(1, len(words) - size + 2)) as p from pieces, (select unnest([1, 2, 3, 4]) as size))),
f as (select lang, size, phrase, count(*) as f from grams group by all having count(*) >= 30),
cand as (select lang, size, phrase, string_split(phrase, ' ') as words, f as a from f where size > 1),
cuts as (
  select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, (2000000::hugeint * c.a // (x.f + y.f))::bigint as score
  from (select *, unnest(range(1, size)) as k from cand) c
  join f x on x.lang = c.lang and x.size = k and x.phrase = array_to_string(c.words[:k], ' ')
  join f y on y.lang = c.lang and y.size = c.size - k and y.phrase = array_to_string(c.words[k + 1:], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, array_to_string(words[p:p + small - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(range(1, size - small + 2)) as p from (select *, unnest(range(2, size)) as small from cand)) group by all),
kept as (select w.* from lowest w left join inside i using (lang, phrase) where i.longer is null or 100 * i.longer < 80 * w.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join totals using (lang) qualify rank <= 2000""",
}
