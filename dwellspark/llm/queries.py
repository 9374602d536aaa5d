"""The operators over the given tables with production parameters, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from dwellspark.llm.bpe import bpe
from dwellspark.llm.conversation_repair import damage, repair_report
from dwellspark.llm.decontaminate import leaks
from dwellspark.llm.licenses import AGREE, PHRASES, RAREST, SLACK, TEMPLATES, agreeing, license_scan
from dwellspark.llm.line_dedup import line_dedup
from dwellspark.llm.prefix_trie import prefix_trie, turn_ids, with_borrowed_beginnings
from dwellspark.llm.quality import quality_rules, train
from dwellspark.llm.secrets import secret_scan
from dwellspark.llm.sharding import shard_records
from dwellspark.llm.simhash import simhash_groups
from dwellspark.llm.substring_dedup import repeated_passages
from dwellspark.llm.url_filter import Rule, url_filter
from dwellspark.llm.warc import through_warc

#: The rank file and the pattern that goes with it.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_records(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(_table(spark, sf_dir, "documents"), RANKS, PATTERN, ids_column=None)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = through_warc(_table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, _table(spark, sf_dir, "labels")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair_report(turns, damage(turns))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_ids(_table(spark, sf_dir, "conversations"))
    return prefix_trie(with_borrowed_beginnings(turns))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("found")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_license_scan": op13_license_scan,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
with lines as (
  select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)),
keyed as (select *, translate(trim(line, {_BLANKS}), {_LOWER}) as key from lines),
shared as (
  select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2)
select doc_id, count(*) as n_lines, count(*) filter (doc_id > first) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (first is null or doc_id <= first), '')) as kept_sha256
from keyed left join shared using (key) group by doc_id
"""

# All aligned word pairs, and windows of 13 of them of which 11 are equal: no seeds.
OP3 = r"""
with d as (
  select doc_id, words, unnest(words) as word, unnest(range(len(words))) as doc_at
  from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as words
        from documents where text is not null)),
b as (
  select item_id, len(words) as n, unnest(words) as word, unnest(range(len(words))) as item_at
  from (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as words
        from benchmark where text is not null)),
same as (
  select doc_id, item_id, doc_at - item_at as lies, doc_at, len(d.words) as doc_n, n from d join b using (word)),
starts as (
  select doc_id, item_id, lies, doc_at - k as start, count(*) as equal
  from same, range(13) as window_of(k)
  where doc_at - k >= greatest(0, lies) and doc_at - k + 13 <= least(doc_n, lies + n)
  group by all having count(*) >= 11)
select doc_id, item_id, count(distinct start) as n_windows, min(start) as start_word, max(start) + 13 as end_word
from starts group by all
"""

OP4 = r"""
with urls as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), """ + _LOWER + r""") as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rule, rule_host, rule_path, says) as (values
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block')),
long(ending) as (values
  ('co.uk'), ('org.uk'), ('ac.uk'), ('com.au'), ('co.jp'), ('com.br'), ('co.nz'), ('co.in'), ('com.cn')),
ruled as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(says, length(rule)) as says
  from urls, rules
  where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id),
hosts as (
  select host, count(*) as n, sum((quality = 0)::int) as bad from urls join labels on doc_id = page_id
  where quality is not null group by host),
named as (
  select *, string_split(host, '.') as parts,
    array_to_string(string_split(host, '.')[-2:], '.') in (select ending from long) as is_long from hosts),
placed as (
  select host, n, bad,
    array_to_string(case when is_long then parts[-3:] else parts[-2:] end, '.') as domain,
    array_to_string(case when is_long then parts[-2:] else parts[-1:] end, '.') as suffix from named),
overall as (select coalesce(sum(bad), 0) + 1.0::double as alpha, coalesce(sum(n - bad), 0) + 1.0::double as beta from placed),
s0 as (select *, pa / (pa + pb) as p from (select suffix, n, bad, alpha - bad as pa, beta - (n - bad) as pb from (select suffix, sum(n) as n, sum(bad) as bad from placed group by suffix), overall)),
s_fit as (select sum(n * (bad / n - p) ** 2) as spread, sum(p * (1 - p)) as noise, sum(p * (1 - p) * (n - 1)) as excess from s0),
s1 as (select suffix, bad + least(m, pa + pb) * p as alpha, n - bad + least(m, pa + pb) * (1 - p) as beta from s0, (select """ + "{strength}" + r""" as m from s_fit)),
d0 as (select *, pa / (pa + pb) as p from (select domain, d.n as n, d.bad as bad, alpha - d.bad as pa, beta - (d.n - d.bad) as pb from (select domain, suffix, sum(n) as n, sum(bad) as bad from placed group by all) d join s1 using (suffix))),
d_fit as (select sum(n * (bad / n - p) ** 2) as spread, sum(p * (1 - p)) as noise, sum(p * (1 - p) * (n - 1)) as excess from d0),
d1 as (select domain, bad + least(m, pa + pb) * p as alpha, n - bad + least(m, pa + pb) * (1 - p) as beta from d0, (select """ + "{strength}" + r""" as m from d_fit)),
h0 as (select *, pa / (pa + pb) as p from (select host, h.n as n, h.bad as bad, alpha - h.bad as pa, beta - (h.n - h.bad) as pb from placed h join d1 using (domain))),
h_fit as (select sum(n * (bad / n - p) ** 2) as spread, sum(p * (1 - p)) as noise, sum(p * (1 - p) * (n - 1)) as excess from h0),
h1 as (select host, bad + least(m, pa + pb) * p as alpha, n - bad + least(m, pa + pb) * (1 - p) as beta from h0, (select """ + "{strength}" + r""" as m from h_fit)),
bad_hosts as (
  select host from (select host, alpha + beta as t, alpha / (alpha + beta) as r, 1.645::double as z from h1)
  where (r + z * z / (2 * t) - z * sqrt(r * (1 - r) / t + z * z / (4 * t * t))) / (1 + z * z / t) > 0.5)
select page_id, host, path, rule,
  coalesce(says, case when host in (select host from bad_hosts) then 'block' else 'allow' end) as verdict
from urls left join ruled using (page_id)
"""
OP8 = """
with p as (select page_id, coalesce(html, '') as html from pages),
last as (select html, max(page_id) as keeper from p group by html)
select page_id, octet_length(encode(html)) as payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(sha1(html), 5 * g + 1, 5) as int) >> (15 - 5 * k)) & 31)::int, 1)), '')), '')
    as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type,
  case when page_id <> keeper then keeper end as refers_to
from p join last using (html)
"""

# CRC-32 by its byte table, of texts that are all ASCII.
CRC = """crc_table as (select list_transform(range(256), lambda n: list_reduce(
    list_prepend(n::bigint, range(8)::bigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as bytes)"""
CRC_OF = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ord(x)::bigint)),
    lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])), 4294967295)"""

OP12 = f"""
with {CRC},
own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place
  from conversations where conv_id is not null),
convs as (select conv_id, {CRC_OF.format("conv_id::varchar")} % 9 as h from (select distinct conv_id from own), crc_table),
begun as (
  select c.conv_id, o.place, role, text from convs c join own o on o.conv_id = c.conv_id - c.conv_id % 5 where o.place < h),
sizes as (select conv_id, count(*) as n from begun group by conv_id),
built as (
  select * from begun union all
  select conv_id, place - h + coalesce(n, 0), role, text from own join convs using (conv_id) left join sizes using (conv_id) where place >= h),
paths as (
  select conv_id, list({{'role': role, 'text': text}} order by place) as turns from built group by conv_id union all
  select conv_id, []::struct(role varchar, text varchar)[] from convs anti join built using (conv_id)),
prefixes as (select conv_id, d, len(turns) as n, turns[1:d] as node from (select *, unnest(range(len(turns) + 1)) as d from paths)),
nodes as materialized (
  select node, d as depth, min(conv_id) as conv_id, count(*) as n_convs,
    (count(*) - 1) * coalesce(strlen(node[-1].text), 0) as value, string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d) as ends
  from prefixes group by node, d),
children as (select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by 1),
below as (
  select up as node, sum(value) as saved, count(*) filter (n_children is null) as n_leaves
  from (select value, n_children, unnest(list_transform(range(depth + 1), lambda k: node[1:k])) as up from nodes left join children using (node)) group by up)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves,
  saved::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join below using (node) left join children using (node) left join nodes p on p.node = n.node[1:n.depth - 1] and p.depth = n.depth - 1
"""

# Backward over the turns, the best cost and edits of what follows at each place of the pattern; then the edits are played.
OP11 = rf"""
with recursive {CRC},
fates as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {CRC_OF.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fate from conversations, crc_table),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case when fate = 1 then '' when fate = 2 then translate(text, '.!?', '') else text end as text
  from fates, range(2) as copy(k) where fate <> 0 and (k = 0 or fate = 3)),
ordered as (
  select *, trim(text, {_BLANKS}) as inside, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
faulty as (
  select *, role[1] as f, case when inside = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when inside[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault from ordered),
turns as (select *, (fault = 'truncated')::int as t, fault in ('blank', 'duplicate') as gone from faulty),
counted as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (wrong) as illegal
  from (select *, lag(f) over (partition by conv_id order by i) || f not in ('su', 'ua', 'au') as wrong from turns) group by conv_id),
best as (
  select conv_id, n as i, {{'c': 0::bigint, 'a': ''}} as b, {{'c': 4::bigint, 'a': 'II'}} as s, {{'c': 2::bigint, 'a': 'I'}} as u, {{'c': 0::bigint, 'a': ''}} as w from counted
  union all
  select conv_id, i, least(ob, {{'c': ou2.c + 2, 'a': 'I' || ou2.a}}), least(os, {{'c': ou2.c + 2, 'a': 'I' || ou2.a}}), ou2, least(ow, {{'c': ou.c + 2, 'a': 'I' || ou.a}})
  from (
    select *, least(ou, {{'c': ow.c + 2, 'a': 'I' || ow.a}}) as ou2 from (
      select best.conv_id, best.i - 1 as i,
        least({{'c': b.c + 3, 'a': 'D' || b.a}}, case when not gone then {{'c': u.c + t + if(f = 'u', 0, 2), 'a': if(f = 'u', 'K', 'R') || u.a}} end,
          case when not gone and f = 's' then {{'c': s.c + t, 'a': 'K' || s.a}} end) as ob,
        least({{'c': s.c + 3, 'a': 'D' || s.a}}, case when not gone then {{'c': u.c + t + if(f = 'u', 0, 2), 'a': if(f = 'u', 'K', 'R') || u.a}} end) as os,
        least({{'c': u.c + 3, 'a': 'D' || u.a}}, case when not gone then {{'c': w.c + t + if(f = 'a', 0, 2), 'a': if(f = 'a', 'K', 'R') || w.a}} end) as ou,
        least({{'c': w.c + 3, 'a': 'D' || w.a}}, case when not gone then {{'c': u.c + t + if(f = 'u', 0, 2), 'a': if(f = 'u', 'K', 'R') || u.a}} end) as ow
      from best join turns on best.conv_id is not distinct from turns.conv_id and best.i = turns.i))),
found as (select conv_id, b.c as cost, b.a as audit from best where i = 0),
played as (
  select conv_id, audit, 0 as k, 0::bigint as used, '' as place, []::varchar[] as kept from found
  union all
  select p.conv_id, audit, k + 1, used + if(audit[k + 1] = 'I', 0, 1),
    case when audit[k + 1] = 'D' then place when audit[k + 1] = 'K' and place = '' and f = 's' then 's' when place = 'u' then 'a' else 'u' end,
    case audit[k + 1] when 'D' then kept when 'K' then list_append(kept, role || ':' || text)
      else list_append(kept, if(place = 'u', 'assistant:', 'user:') || if(audit[k + 1] = 'I', '', text)) end
  from played p left join turns on p.conv_id is not distinct from turns.conv_id and turns.i = used + 1 where k < length(audit))
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(p.audit, '') as audit, sha256(coalesce(array_to_string(kept, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on o.conv_id is not distinct from c.conv_id
left join found f on o.conv_id is not distinct from f.conv_id
left join (select * from played where k = length(audit)) p on o.conv_id is not distinct from p.conv_id
"""

def _listed(*rows: tuple) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


# No index: all places of all notices' rare words are counted.
OP13 = rf"""
with docs as materialized (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents),
spaced as (select *, ' ' || array_to_string(words, ' ') || ' ' as flat from docs),
phrase(phrase) as (values {_listed(*[(x,) for x in sorted({p for t in TEMPLATES for p in t.phrases} | {p for p, _ in PHRASES})])}),
found as (
  select doc_id, phrase, unnest(list_filter(range(len(words)), lambda i: words[i + 1:i + len(string_split(phrase, ' '))] = string_split(phrase, ' '))) as p
  from spaced, phrase where contains(flat, ' ' || phrase || ' ')),
base(phrase, label) as (values {_listed(*PHRASES)}),
based as (
  select doc_id, count(*) as n_base, min(p) as first_word, max(p) as last_word, list(distinct label) as labels from found join base using (phrase) group by doc_id),
template(label, text, enough) as (values {_listed(*[(t.label, t.text, agreeing(t, AGREE)) for t in TEMPLATES])}),
needs(label, phrase) as (values {_listed(*[(t.label, p) for t in TEMPLATES for p in t.phrases])}),
wants as (select label, count(*) as many from needs group by label),
place as (select label, enough, len(string_split(text, ' ')) as n, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as k from template),
word as (select doc_id, unnest(words) as word, unnest(range(len(words))) as i from docs),
held as (select word, count(distinct doc_id) as documents from word where word in (select word from place) group by word),
near as (
  select doc_id, label from found join needs using (phrase) join wants using (label) group by doc_id, label having count(distinct phrase) = any_value(many)),
rare as (
  select * from (
    select doc_id, label, word, row_number() over (partition by doc_id, label order by documents, word) as r
    from (select distinct doc_id, label, word from near join place using (label) join word using (doc_id, word)) join held using (word)) where r <= {RAREST}),
origin as (
  select doc_id, label, i - k as at_word, any_value(n) as n from rare join place using (label, word) join word using (doc_id, word)
  group by doc_id, label, i - k having count(*) >= any_value(enough)),
stands as (
  select o.doc_id, o.label, at_word, n from origin o join needs using (label) join wants using (label)
  join found f on f.doc_id = o.doc_id and f.phrase = needs.phrase and f.p >= at_word - {SLACK} and f.p < at_word + n + {SLACK}
  group by all having count(distinct needs.phrase) = any_value(many)),
judged as (
  select doc_id, list(distinct label) as labels, max(round(share, 6)) as score from (
    select s.doc_id, s.label, len(list_intersect(string_split(text, ' '), words[greatest(at_word - {SLACK}, 0) + 1:at_word + n + {SLACK}]))
      / len(list_distinct(string_split(text, ' '))) as share
    from stands s join template using (label) join docs using (doc_id)) group by doc_id)
select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(list_sort(based.labels), ','), '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(judged.labels, [])))), ',') as labels, coalesce(score, 0.0)::double as score
from docs left join based using (doc_id) left join judged using (doc_id)
"""

_STRENGTH = (
    "case when coalesce(excess, 0) = 0 or spread <= noise then 1000.0 else "
    "round(least(greatest((1 - least((spread - noise) / excess, 0.5)) / least((spread - noise) / excess, 0.5), 1.0), 1000.0), 6) end"
)

ORACLES = {
    "op1_line_dedup": OP1,
    "op3_decontaminate": OP3,
    "op4_url_filter": OP4.replace("{strength}", _STRENGTH),
    "op8_warc": OP8,
    "op11_conversation_repair": OP11,
    "op12_prefix_trie": OP12,
    "op13_license_scan": OP13,
}
