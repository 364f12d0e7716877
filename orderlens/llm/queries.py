"""The registered queries of this subpackage: each applies one operator, with its production
parameters, to a whole table and derives the contract's columns from what the operator returns."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.llm import containment, crosstok, ledger, lm, mixing, ngramjoin, periodic, qda, streamdedup, suffixes, toxicity, urls, warc
from orderlens.llm.store import Scratch, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    rows, slots, pieces = mixing.mix_sources(table(spark, sf_dir, "documents"), scratch=scratch)
    return mixing.words_taken(rows, slots, pieces).select("doc_id", "size", "source", "source_size", "target", "taken")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = suffixes.repeated_passages(docs)
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    ranges = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["stop"])), " ")
    return (docs.select("doc_id", suffixes.row_key().alias("row")).distinct().join(found, "row")
            .select("doc_id", ranges("repeated").alias("repeated"), ranges("later").alias("later"),
                    words("repeated").alias("n_repeated"), words("later").alias("n_later")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ledger.apply_policy(ledger.quality_ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.lattice_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streamdedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align_tokenizers(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


def _planted_periods(doc_ids: list, counts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The query's rewriting of some texts: from a word drawn by the id on, the words go round."""
    out = []
    for i, (doc_id, n) in enumerate(zip(doc_ids, counts.tolist(), strict=True)):
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            places = np.arange(n)
            places[a:] = a + (places[a:] - a) % p
            out.append((i, places))
    return out


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are not rewritten."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), _planted_periods)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_mixing_sources": op1_mixing_sources,
    "op2_url_filters": op2_url_filters,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_streaming_exact_dedup": op11_streaming_exact_dedup,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

WORD_SQL = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": r"""
with recursive parts as (
  select page_id, url, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path,
    case when contains(url, '://') then regexp_replace(url, '(?s)#.*', '') end page
  from pages),
rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
urls as (select page, any_value(host) host, any_value(path) path from parts where page is not null group by page),
ruled as (
  select page, verdict from urls join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  qualify row_number() over (partition by page order by length(rhost || rpath) desc, verdict) = 1),
linked as (
  select page a, regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?i)\bhref\s*=\s*["'']?([^"''>\s]+)', 1) b
  from parts where page is not null),
edges as (select a, b from linked where contains(b, '://') union select b, a from linked where contains(b, '://')),
reach(page, other) as (select page, page from urls union select r.page, e.b from reach r join edges e on e.a = r.other),
inherited as (
  select reach.page, bool_or(verdict = 'allow') allowed, bool_or(verdict = 'block') blocked
  from reach join ruled on ruled.page = reach.other group by reach.page)
select page_id, host, path, r.rule, coalesce(r.verdict, case when blocked and not allowed then 'block' else 'allow' end) verdict
from parts left join inherited using (page) left join lateral (
  select rhost || rpath as rule, verdict from rules
  where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  order by length(rhost || rpath) desc limit 1) r on true""",
    "op3_ngram_jaccard_join": rf"""
with recursive d as (select row_number() over () r, doc_id, text from documents),
w as (select r, word, i from (
  select r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD_SQL})) word,
    generate_subscripts(regexp_extract_all(text, {WORD_SQL}), 1) i from d)),
grams as (
  select r, i, word || chr(10) || lead(word) over t || chr(10) || lead(word, 2) over t || chr(10) || lead(word, 3) over t g, count(*) over (partition by r) n,
    string_agg(word, chr(10)) over (partition by r order by i rows between unbounded preceding and unbounded following) whole
  from w window t as (partition by r order by i)),
shingles as materialized (select distinct r, md5(case when n < 4 then whole else g end) g from grams where case when n < 4 then i = 1 else g is not null end),
sizes as materialized (select r, count(*) n from shingles group by r),
links as materialized (
  select a, b from (select x.r a, y.r b, count(*) c from shingles x join shingles y on x.g = y.g and x.r <> y.r group by x.r, y.r)
  join sizes sa on sa.r = a join sizes sb on sb.r = b where 100 * c >= 85 * (sa.n + sb.n - c)),
reach as (select r, r o from d union select reach.r, links.b from reach join links on links.a = reach.o)
select d.doc_id, coalesce(any_value(sizes.n), 0) n_shingles, min(o.doc_id) component_id, coalesce(any_value(l.n), 0) n_links
from reach join d on d.r = reach.r join d o on o.r = reach.o left join sizes on sizes.r = reach.r
  left join (select a, count(*) n from links group by a) l on l.a = reach.r
group by reach.r, d.doc_id""",
    "op5_suffix_array_dedup": rf"""
with d as (select row_number() over () r, doc_id, text from (select distinct doc_id, text from documents)),
w as (
  select r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD_SQL})) word,
    generate_subscripts(regexp_extract_all(text, {WORD_SQL}), 1) - 1 i from d),
windows as (
  select r, doc_id, i, lead(i, 49) over t last, md5(string_agg(word, chr(10)) over (partition by r order by i rows between current row and 49 following)) h
  from w window t as (partition by r order by i)),
counted as (
  select r, doc_id, i, count(*) over (partition by h) n, row_number() over (partition by h order by doc_id nulls last, r, i) k from windows where last is not null),
starts as (select 'repeated' kind, r, doc_id, i from counted where n > 1 union all select 'later', r, doc_id, i from counted where n > 1 and k > 1),
islands as (
  select *, sum(case when i <= before + 50 then 0 else 1 end) over (partition by kind, r order by i rows unbounded preceding) g
  from (select *, lag(i) over (partition by kind, r order by i) before from starts)),
ranges as (select kind, r, doc_id, min(i) a, max(i) + 50 b from islands group by kind, r, doc_id, g)
select doc_id, coalesce(string_agg(a || '-' || b, ' ' order by a) filter (kind = 'repeated'), '') repeated,
  coalesce(string_agg(a || '-' || b, ' ' order by a) filter (kind = 'later'), '') later,
  cast(sum(b - a) filter (kind = 'repeated') as bigint) n_repeated, cast(coalesce(sum(b - a) filter (kind = 'later'), 0) as bigint) n_later
from ranges group by r, doc_id""",
    "op6_benchmark_decontamination": rf"""
with texts as (
  select 'd' kind, row_number() over () r, doc_id id, text from documents
  union all select 'i', row_number() over (), item_id, text from benchmark),
w as (
  select kind, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD_SQL})) word,
    generate_subscripts(regexp_extract_all(text, {WORD_SQL}), 1) i from texts),
grams as (
  select kind, r, i, count(*) over (partition by kind, r) n, lead(word, 4) over t last,
    string_agg(word, chr(10)) over (partition by kind, r order by i rows between current row and 4 following) g
  from w window t as (partition by kind, r order by i)),
shingles as (select distinct kind, r, g from grams where last is not null or n < 5 and i = 1),
sizes as (select r, count(*) n from shingles where kind = 'i' group by r),
shared as (select d.r dr, i.r ir, count(*) n from shingles d join shingles i using (g) where d.kind = 'd' and i.kind = 'i' group by d.r, i.r)
select d.id doc_id, i.id item_id, sizes.n n_item, shared.n n_shared
from shared join sizes on sizes.r = ir join texts d on d.kind = 'd' and d.r = dr join texts i on i.kind = 'i' and i.r = ir
where 100 * shared.n >= 80 * sizes.n""",
    "op7_warc": """
with p as (select page_id, url, coalesce(html, '') html from pages),
d as (select page_id, url, strlen(html) n, sha1(html) digest, count(*) over (partition by html) c,
  max(page_id) over (partition by html) first from p)
select page_id, cast(n as bigint) payload_bytes, digest payload_digest,
  case when n >= 1000 and c > 1 and page_id <> first then 'revisit' else 'response' end record_type,
  case when n >= 1000 and c > 1 and page_id <> first then first end refers_to
from d""",
    "op8_quality_rules": rf"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') text from documents),
w as (select r, unnest(regexp_extract_all(text, {WORD_SQL})) word, generate_subscripts(regexp_extract_all(text, {WORD_SQL}), 1) i from d),
windows as (
  select r, i, word, lead(word) over t b, lead(word, 2) over t c, lag(word) over t prev from w window t as (partition by r order by i)),
twice as (select r, i, count(*) over (partition by r, word, b, c) n from windows where b is not null and c is not null),
covered as (select distinct r, i + k p from twice, range(3) k(k) where n >= 2),
repeats as (select r, count(*) n from covered group by r),
counted as (
  select r, count(*) n_words, sum(length(word)) word_chars, count(*) filter (prev = word) n_runs,
    count(*) filter (regexp_matches(word, '[#*$%&|<>!]$')) n_symbol_words from windows group by r),
lines as (select r, unnest(string_split(text, chr(10))) line from d),
line_counts as (
  select r, sum(n) n_lines, sum(n - 1) n_dup_lines
  from (select r, line, count(*) n from lines where regexp_matches(line, {WORD_SQL}) group by r, line) group by r),
m as (
  select d.doc_id, coalesce(counted.n_words, 0) n_words, cast(coalesce(word_chars, 0) as bigint) word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) n_dup_lines,
    coalesce(n_lines, 0) n_lines, coalesce(repeats.n, 0) n_repeat_words, coalesce(n_runs, 0) n_runs, coalesce(n_symbol_words, 0) n_symbol_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) n_upper, length(regexp_replace(text, '[^0-9]', '', 'g')) n_digits,
    length(regexp_replace(text, '[^!?]', '', 'g')) n_shouts
  from d left join counted using (r) left join line_counts using (r) left join repeats using (r)),
rules as (
  select *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 100 * n_symbols > 25 * n_words, 100 * n_upper > 60 * word_chars,
    100 * n_shouts > 40 * n_words, n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines, 100 * n_runs > 20 * n_words,
    word_chars < 2 * n_words or word_chars > 20 * n_words, 100 * n_symbol_words > 30 * n_words, 100 * n_digits > 40 * word_chars] bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits[1] or bits[2] base_failed,
  not list_contains(bits, true) kept, cast(list_sum(list_transform(bits, lambda b, i: case when b then 1 << (i - 1) else 0 end)) as bigint) failed
from rules""",
    "op11_streaming_exact_dedup": """
select doc_id, max(doc_id) over same keep_id, count(*) over same group_size,
  row_number() over (same order by doc_id desc nulls last) = 1 kept, sha256(coalesce(text, '')) text_sha256
from documents window same as (partition by coalesce(text, ''))""",
}
