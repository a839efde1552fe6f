"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import math

from . import chat_format, merkle, prefix_trie, quality_rules

CRC = """crc_table as (select list(v order by n) as crc from (select n, list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) as v from range(256) r(n)))"""


def crc32(bytes_of: str) -> str:
    """CRC-32 of a column's UTF-8 bytes, a byte at a time; needs crc_table in scope."""
    each = f"list_transform(range(octet_length(encode({bytes_of}))), lambda i: ('0x' || substr(hex(encode({bytes_of})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce({each}, lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295)"


def jump(shards: int) -> str:
    """Jump consistent hash of key: (b, j, k) until j leaves the range; every step's state that is inside moves on."""
    k = "((s.k * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint)"
    return f"list_reduce(range(120), lambda s, i: case when s.j >= {shards} then s else {{'b': s.j, 'j': floor((s.j + 1) * (2147483648.0::double / (({k} // 8589934592::hugeint)::double + 1)))::bigint, 'k': {k}}} end, {{'b': 0::bigint, 'j': 0::bigint, 'k': key}}).b"


SHARDS = f"""with {CRC},
keyed as (select doc_id, coalesce(text, '') as text, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint::hugeint as key from documents),
placed as (select doc_id, (octet_length(encode(text)) + 16)::bigint as size, {crc32('text')} as text_crc32, ({jump(40)})::int as shard, ({jump(41)})::int as grown_shard from keyed, crc_table)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard from placed"""

_GROWTH = (1 + quality_rules.ERROR) / (1 - quality_rules.ERROR)
_LOW = math.ceil(math.log(1e-6) / math.log(_GROWTH))


def _quality() -> str:
    values = {"symbols_per_word": "n_symbols / greatest(n_words, 1)::double", "echo_share": "n_echo_words / greatest(n_words, 1)::double", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)::double", "word_length": "word_chars / greatest(n_words, 1)::double"}
    long = " union all ".join(f"select lang, source, '{m}' as measure, ceil(ln(greatest({v}, 1e-6)) / {math.log(_GROWTH)!r})::int as bucket from base where not base_failed" for m, v in values.items())
    spread = "case measure " + " ".join(f"when '{m}' then {s}" for m, (_, s) in quality_rules.MEASURES.items()) + " end"
    levels = []
    for tag, keys in (("a", ["lang", "source"]), ("b", ["lang"]), ("c", [])):
        part = ", ".join([*keys, "measure"])
        own = ", ".join([*keys, "measure", "bucket"])
        levels.append(f"""{tag}0 as (select {own}, count(*) as n from long group by {own}),
{tag}1 as (select *, sum(n) over (partition by {part}) as total, sum(n) over (partition by {part} order by bucket) as upto from {tag}0),
{tag} as (select {part}, any_value(total) as total, min(case when upto >= total * 0.25 then bucket end) as b1, min(case when upto >= total * 0.5 then bucket end) as b2, min(case when upto >= total * 0.75 then bucket end) as b3 from {tag}1 group by {part})""")
    middle = lambda b: f"case when {b} <= {_LOW} then 0.0 else pow({_GROWTH!r}, {b}) * {2 / (1 + _GROWTH)!r} end"
    least = quality_rules.MIN_ROWS
    b1, b2, b3 = (f"case when a.total >= {least} then a.{b} when b.total >= {least} then b.{b} else c.{b} end" for b in ("b1", "b2", "b3"))
    far = quality_rules.BEYOND * quality_rules.REACH
    checks = []
    for m, v in values.items():
        side = quality_rules.MEASURES[m][0]
        low = f" and ({v}) >= greatest(q1 - {quality_rules.REACH} * iqr, q2 - {far} * above)" if side == "both" else ""
        checks.append(f"when '{m}' then ({v}) <= least(q3 + {quality_rules.REACH} * iqr, q2 + {far} * below){low}")
    return f"""with words as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
each as (select rid, i, word, concat_ws(chr(1), word, lead(word) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o) as gram, lead(word, 4) over o is not null as whole, word = lag(word) over o as echo
  from words, unnest(w) with ordinality as t(word, i) window o as (partition by rid order by i)),
grams as (select rid, i, echo, whole and count(*) over (partition by rid, whole, gram) > 1 as again from each),
covered as (select rid, echo, bool_or(again) over (partition by rid order by i rows between 4 preceding and current row) as hit from grams),
repeats as (select rid, count(*) filter (where hit) as n_repeat_words, count(*) filter (where echo) as n_echo_words from covered group by rid),
counts as (select words.rid, doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) as n_lines,
  len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) as n_distinct,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_echo_words, 0)::bigint as n_echo_words from words left join repeats using (rid)),
base as (select *, (n_lines - n_distinct)::bigint as n_dup_lines, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts),
long as ({long}),
{", ".join(levels)},
judged as (select base.*, m.measure, {b1} as b1_, {b2} as b2_, {b3} as b3_ from base, (values {", ".join(f"('{m}')" for m in values)}) m(measure)
  left join a on a.lang is not distinct from base.lang and a.source is not distinct from base.source and a.measure = m.measure
  left join b on b.lang is not distinct from base.lang and b.measure = m.measure left join c on c.measure = m.measure),
fenced as (select *, {middle('b1_')} as q1, {middle('b2_')} as q2, {middle('b3_')} as q3, greatest(q3 - q1, {spread}) as iqr, greatest(q2 - q1, ({spread}) / 2) as below, greatest(q3 - q2, ({spread}) / 2) as above from judged),
passed as (select rid, bool_and(coalesce(case measure {" ".join(checks)} end, true)) as ok from fenced group by rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and ok as kept from base join passed using (rid)"""


BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_DIGEST = "array_to_string(list_transform(range(32), lambda i: substr(" + BASE32 + ", (('0x' || substr(hexed, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - i % 4 * 5)::int) & 31) + 1, 1)), '')"

WARC = """with hashed as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hexed, sha256(coalesce(html, '')) as address from pages),
heads as (select *, min(page_id) over (partition by address) as first from hashed)
select page_id, octet_length(encode(html))::bigint as payload_bytes, """ + _DIGEST.replace("(('0x'", "((('0x'") + """ as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from heads"""

#: Messages of a part in the query of parts: few, so that short dialogues have several.
FEW = 4

ORACLES = {"op1_jump_hash_shards": SHARDS, "op2_quality_rules": _quality(), "op6_perspective_rotation": chat_format.ROTATED_SQL, "perspective_parts": chat_format.parts_sql(FEW), "op7_content_addressed_warc": WARC, "op12_prefix_trie": prefix_trie.trie_sql(CRC, crc32), "op13_merkle_manifest": merkle.audited_sql(CRC, crc32)}
