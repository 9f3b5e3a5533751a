"""Queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import table


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    from loomspark.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    from loomspark.llm.pii import find, report

    return report(find(table(spark, sf_dir, "documents")))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    from loomspark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3).select("doc_id", "size", "source_size", "target", "taken")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    from loomspark.llm.decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8, recall=0.99)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    from loomspark.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    from loomspark.llm.chat import format_chats, read_back

    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(table(spark, sf_dir, "conversations").unionByName(probe, allowMissingColumns=True)))


def op7_tiff(spark, sf_dir: str) -> DataFrame:
    from loomspark.llm.tiff import digest_pages, read_pages, store_texts

    return digest_pages(read_pages(store_texts(table(spark, sf_dir, "documents"))))


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from loomspark.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from loomspark.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomspark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), limit=512)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


CHAT_SQL = r"""with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, x, case x when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) r(x)),
f as (select *, '### ' || regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g') || ': ' || regexp_replace(text, '(\\|###|</turn>|: )', '\\\1', 'g') || '</turn>' || chr(10) as formatted from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(formatted)) as bigint) as formatted_chars
from f group by conv_id"""


#: Texts are cut into 256 bytes with the 49 after them before their strings are taken, as ``substr`` counts from the start.
REPEATS_SQL = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
k as (select doc_id, x, unnest(range(0, greatest(1, (length(x) + 511) // 512))) as c from d),
y as (select doc_id, c * 256 as base, least(256, (length(x) - c * 512) // 2) as n, substr(x, c * 512 + 1, 512 + 98) as z from k),
p as (select doc_id, base + i as i, substr(z, 2 * i + 1, 2) as b, case when 2 * i + 100 <= length(z) then substr(z, 2 * i + 1, 100) end as w from (select *, unnest(range(0, n)) as i from y)),
f as (select w, min(doc_id) as m from p where w is not null group by w having min(doc_id) < max(doc_id)),
g as (select p.doc_id, i, b, cast(coalesce(f.m < p.doc_id, false) as int) as gone from p left join f on p.w = f.w),
c as (select *, max(gone) over (partition by doc_id order by i rows between 49 preceding and current row) as r from g),
e as (select *, coalesce(lag(r) over (partition by doc_id order by i), 0) as before from c),
s as (select doc_id, sum(r) as n_removed, count(*) filter (r = 1 and before = 0) as n_spans, string_agg(b, '' order by i) filter (r = 0) as kept from e group by 1)
select doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join s using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Twins where SQL can express an operator; the others are held against brute force by tests."""
    from loomspark.llm import mixing, pii_sql, secrets_sql

    return {"op2_pii": pii_sql.query(), "op3_mixing": mixing.query(), "op5_secret_scan": secrets_sql.query(), "op6_chat_format": CHAT_SQL, "op9_suffix_dedup": REPEATS_SQL}
