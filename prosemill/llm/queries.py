"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, chat, decontam, jaccard, langid, piece, quality, repeats, secrets, sharding, spelling, urlfilter, vectorcodes
from .common import stored, table


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; the folder is a parameter, ``PROSEMILL_TOKENIZERS``."""
    folder = os.environ.get("PROSEMILL_TOKENIZERS", "/opt/tokenizers")
    path = os.path.join(folder, name)
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "votes", "posterior")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "set_id")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_trees(chat.from_turns(told.unionByName(planted))))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = [F.size(F.filter(F.transform("spans", lambda s: s.kind), lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *count, F.sha2(secrets.listed("spans", True), 256).alias("base_sha256"), secrets.listed("spans", False).alias("spans"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece.encode_decode_sums(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytebpe.encode_decode_sums(docs, tokenizer_file("byte_bpe_50k.tiktoken")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), drop_every=31)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.encode(table(spark, sf_dir, "embeddings"))
    summed = vectorcodes.with_label_sums(stored(coded, "vector-codes"))
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).alias("codebooks_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filters": op2_url_filters,
    "op3_quality_rules": op3_quality_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_secret_scans": op8_secret_scans,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_vector_codes": op13_vector_codes,
}

_URL_SQL = r"""with u as (select page_id, case when contains(url, '://') then regexp_replace(substr(url, instr(url, '://') + 3), '#.*', '', 's') else '' end as rest from pages),
  s as (select page_id, translate(regexp_extract(rest, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?]*([^?]*)', 1) as path, regexp_extract(rest, '\?.*', 0, 's') as query from u),
  r as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(v, h, p)),
  b as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from s join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1),
  g as (select page_id, x from s, (values ('%#%.exe'), ('%#%.zip'), ('%#%/login%'), ('%#%/cart/%'), ('%#%/wp-admin/%'), ('%#%?%sessionid=%'), ('%#%?%utm\_source=%'), ('%.onion#%'), ('%xn--%#%'), ('%#%/../%')) t(x) where host || '#' || path || query like x escape '\'),
  w as (select page_id, arg_max(replace(replace(replace(x, '\_', '_'), '?', '\?'), '%', '*'), length(replace(replace(x, '\_', '_'), '?', '\?')) * 1000000 - ascii(x)) as glob_ from g group by 1)
  select page_id, host, path, rule, coalesce(v, case when w.glob_ is null then 'allow' else 'block' end) as verdict, case when rule is null then w.glob_ end as glob from s left join b using (page_id) left join w using (page_id)"""
_CHAT_SQL = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e as (select *, length(text) + length(text) - length(replace(replace(replace(text, '<', ''), '[', ''), '\', '')) as body, length(role) + length(role) - length(replace(replace(replace(role, '<', ''), '[', ''), '\', '')) as head from c)
  select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(body + case role when 'user' then 16 when 'assistant' then 7 else 20 + head end)::bigint as formatted_chars from e group by 1"""
_JACCARD_SQL = r"""with recursive w as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') as w from documents),
  s as materialized (select distinct doc_id, case when len(w) < 4 then w else w[i : i + 3] end as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from w where len(w) > 0)),
  n as materialized (select doc_id, count(*) as n from s group by 1),
  c as materialized (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
  l as materialized (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)),
  r as (select doc_id as a, doc_id as b from n union select r.a, l.b from r join l on l.a = r.b),
  m as (select a, min(b) as component_id from r group by 1),
  k as (select doc_id, hash(list(g order by g)) as h from s group by 1), f as (select doc_id, min(doc_id) over (partition by h) as set_id from k)
  select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component_id, w.doc_id) as component_id, coalesce(set_id, w.doc_id) as set_id from w left join n using (doc_id) left join m on m.a = w.doc_id left join f on f.doc_id = w.doc_id"""

_SPELLING_SQL = r"""with recursive tab as (select i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as v from (select unnest(range(0, 256))::bigint as i)),
  crc as materialized (select list(v order by i) as t from tab),
  runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
  r as materialized (select coalesce(doc_id::varchar, '') as d, w, count(*) as n from runs where length(w) >= 7 group by 1, 2),
  b as (select d, w, n, [4294967295::bigint] || list_transform(range(0, strlen(hex(encode(d || ':' || w))) // 2), lambda k: ('0x' || substr(hex(encode(d || ':' || w)), 2 * k + 1, 2))::bigint) as bytes from r),
  h as (select d, w, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as h from b, crc),
  k as (select case when h % 31 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from h),
  v as materialized (select word, sum(n)::bigint as n from k where length(word) >= 7 group by 1 having sum(n) >= 2),
  places as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
  holes as materialized (select word, n, substr(word, 1, i::int - 1) || '*' || substr(word, i::int + 1) as hole from places),
  gone as (select distinct word, n, substr(word, 1, i::int - 1) || substr(word, i::int + 1) as other from places),
  shorter as (select g.word as a, g.n as an, v.word as b, v.n as bn from gone g join v on v.word = g.other),
  near as materialized (select x.word as a, x.n as an, y.word as b, y.n as bn from holes x join holes y on x.hole = y.hole and x.word <> y.word union all select a, an, b, bn from shorter union all select b, bn, a, an from shorter),
  best as (select a, count(*) as n_near, min(row(-bn, b)) as m from near group by 1),
  f as materialized (select word, n, coalesce(n_near, 0) as n_near, case when -m[1] >= 10 * n then m[2] end as form, case when -m[1] >= 10 * n then -m[1] end as form_n from v left join best on a = word),
  way as (select word, word as root, form from f union all select way.word, f.word, f.form from way join f on f.word = way.form)
  select f.word, f.form, way.root, f.n, f.n_near, f.form_n::bigint as form_n from f join way on way.word = f.word and way.form is null"""


def _codes_sql(rounds: int = 2) -> str:
    """Training as a chain of tables, one codebook a round."""
    near = "select x.id, x.p, min(row(d, e))[2] as e, min(row(d, e))[1] as d from (select x.id, x.p, c.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::bigint as d from parts x join book{k} c on c.p = x.p) x group by 1, 2"
    tables = [
        "kept as materialized (select vec_id as id, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "parts as materialized (select id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as v from kept, range(0, 16) t(p))",
        "book0 as materialized (select p, row_number() over (partition by p order by id) - 1 as e, v from parts where id in (select id from kept order by id limit 64))",
    ]
    for k in range(rounds):
        tables += [
            f"near{k} as materialized ({near.format(k=k)})",
            f"sums{k} as (select p, e, i, floor_div(sum(x)::hugeint, count(*)) as m from (select p, e, unnest(range(1, len(v) + 1)) as i, unnest(v) as x from near{k} join parts using (id, p)) group by 1, 2, 3)",
            f"means{k} as (select p, e, list(m order by i) as m from sums{k} group by 1, 2)",
            f"book{k + 1} as materialized (select p, e, coalesce(m, v) as v from book{k} left join means{k} using (p, e))",
        ]
    return (
        "with " + ", ".join(tables) + f", last as ({near.format(k=rounds)}), coded as (select id as vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from last group by 1), "
        f"digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds}) "
        "select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept on id = vec_id, digest"
    ).replace("floor_div(sum(x)::hugeint, count(*))", "((sum(x)::hugeint - (((sum(x)::hugeint % count(*)) + count(*)) % count(*))) // count(*))::bigint")


#: Where a method learns, draws or merges, SQL has no twin; tests compare those with brute force.
ORACLE_SQL: dict[str, str] = {"op2_url_filters": _URL_SQL, "op4_jaccard_join": _JACCARD_SQL, "op5_chat_formatting": _CHAT_SQL, "op12_spelling_variants": _SPELLING_SQL, "op13_vector_codes": _codes_sql()}
