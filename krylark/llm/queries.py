"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, language_id, packing, pii, quality_rules, simhash, token_store, url_filter
from .common import read_table, shared_dir, spread

#: The rules that the URL query judges by: host, path, action.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    shards = token_store.write_shards(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, keep_space=False, folder=folder)
    return token_store.read_documents(spark, folder, shards)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), read_table(spark, sf_dir, "benchmark"))


def pack_query(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, keep_space=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_query(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as t(host, path, action)")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


TRAP = r"\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(trap)))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_simhash": op2_simhash,
    "op3_token_store": op3_token_store,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_format": op9_chat_format,
    "op10_pii": op10_pii,
}

ORACLE_SQL = {
    "op7_url_filter": r"""
with rules(rule_host, rule_path, action) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest as (select page_id, case when url is not null and contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as rid from rest),
hits as (select rid, rule_host || rule_path as rule, action, row_number() over (partition by rid order by length(rule_host || rule_path) desc, length(rule_host) desc, action desc) as k
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from parts left join (select * from hits where k = 1) using (rid)
""",
    "op8_quality_rules": r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
windows as (select rid, i, list_slice(words, i, i + 7) as win from (select rid, words, unnest(generate_series(1, len(words) - 7)) as i from w where len(words) >= 9)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as n from windows) where n > 1),
covered as (select rid, count(distinct i + k) as n_repeat_words from twice, generate_series(0, 7) as s(k) group by rid),
m as (select doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
  length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_upper, length(regexp_replace(text, '[^a-z]+', '', 'g')) as n_lower,
  len(list_filter(generate_series(2, len(words)), lambda i: words[i] = words[i - 1])) as n_adjacent from w left join covered using (rid)),
f as (select *, (case when n_words < 20 then 1 else 0 end) | (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end) | (case when 10 * n_symbols > n_words then 4 else 0 end) | (case when n_upper > n_lower then 8 else 0 end)
  | (case when 100 * n_adjacent > 20 * n_words then 16 else 0 end) | (case when 100 * n_dup_lines > 70 * n_lines then 32 else 0 end) | (case when word_chars < 2 * n_words or word_chars > 25 * n_words then 64 else 0 end) as failures from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 as base_failed, failures = 0 as kept, failures::bigint as failures from f
""",
    "op9_chat_format": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(role) + length(regexp_replace(role, '[^\\#<\n]+', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]+', '', 'g')) + 13 as chars from t)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from e group by conv_id
""",
}
