"""The same results in plain SQL (DuckDB), for the operators that SQL can express; written apart from the Spark plans."""

from __future__ import annotations

from .chosen_path_join import LIKENESS, SHINGLE
from .license_scan import DRIFT, LEAST_LIKENESS, LEAST_VOTES, PHRASES, TEMPLATES
from .minmax_dedup import PERCENT, SHINGLE as NEAR_SHINGLE

#: op4: every 50 words of every document, looked up in full.
SUBSTRING = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), stretches as (
  select doc_id, i, array_to_string(w[i : i + 49], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)
), firsts as (
  select s, min(doc_id) as first from stretches group by s
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as i from stretches join firsts using (s) where doc_id > first
), lost as (
  select doc_id, list(i) as lost, count(*) as n from gone group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string([x for x, k in w if lost is null or not list_contains(lost, k)], ' ')) as kept_sha256
from words left join lost using (doc_id)
"""


def licenses() -> str:
    """op6: phrases by the words that follow each place, templates by the words of the spans that neighbouring diagonals have."""

    def rows(texts, base: bool, first: int) -> list[str]:
        known = lambda text: ", ".join(f"'{w}'" for w in dict.fromkeys(text.split()))
        return [f"({first + k}, '{label}', string_split('{text}', ' '), [{known(text)}], {base})" for k, (label, text) in enumerate(texts)]

    listed = ", ".join(rows(PHRASES, True, 0) + rows(TEMPLATES, False, len(PHRASES)))
    letters = "array_to_string(list_transform({0}, lambda x: chr(coalesce(nullif(list_position(known, x), 0), 127)::int)), '')"
    return rf"""
with words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), templates(template, label, t, known, base) as (values {listed}
), along as (
  select doc_id, unnest(w) as a, unnest(range(len(w))) as place from words
), pairs as (
  select doc_id, place, a, lead(a) over (partition by doc_id order by place) as b from along
), wanted as (
  select template, len(t) - 1 as n, unnest(range(len(t) - 1)) as q, unnest(t[1 : len(t) - 1]) as a, unnest(t[2 :]) as b from templates
), diagonals as (
  select doc_id, template, n, place - q as diagonal, count(*) as votes, min(place) as lo, max(place) as hi
  from pairs join wanted using (a, b) group by doc_id, template, n, place - q
), bands as (
  select doc_id, template, n, sum(votes) over near as total, min(lo) over near as start, max(hi) over near + 2 as stop
  from diagonals where template >= {len(PHRASES)}
  window near as (partition by doc_id, template order by diagonal range between current row and {DRIFT} following)
), spans as (
  select distinct doc_id, template, start, stop from bands where total >= {LEAST_VOTES} * n
), verified as (
  select doc_id, label, greatest(0.0, 1 - levenshtein({letters.format("w[start + 1 : stop]")}, {letters.format("t")}) / len(t)::double) as likeness
  from spans join words using (doc_id) join templates using (template)
), found as (
  select doc_id, max(likeness) as score, list(distinct label) filter (where likeness >= {LEAST_LIKENESS}) as more from verified group by doc_id
), places as (
  select doc_id, label, diagonal from diagonals join templates using (template) where base and votes = n
), phrases as (
  select doc_id, count(*) as n_base, min(diagonal) as first_word, max(diagonal) as last_word, list(distinct label) as own
  from places group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(array_to_string(list_sort(own), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(own, more))), ','), '') as labels,
  case when n_base > 0 then 1.0 else coalesce(score, 0.0) end::double as score
from words left join found using (doc_id) left join phrases using (doc_id)
"""


#: op7: all pairs of sets that share a shingle, and what they join, by smallest id.
JACCARD = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as w from documents
), shingled as (
  select doc_id, list_sort(list_distinct([array_to_string(w[i : i + {SHINGLE - 1}], ' ') for i in range(1, greatest(len(w) - {SHINGLE - 2}, 2))])) as s
  from words where len(w) > 0
), sets as (
  select min(doc_id) as rep, s, count(*) as copies, list(doc_id) as ids from shingled group by s
), tokens as (
  select rep, len(s) as n, unnest(s) as token from sets
), shared as (
  select x.rep as a, y.rep as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as k
  from tokens x join tokens y on x.token = y.token and x.rep < y.rep group by x.rep, y.rep
), links as (
  select a, b from shared where k >= {LIKENESS} * (n + m - k) - 1e-6
), linked as (
  select a, b from links union all select b, a from links
), reached(a, b) as (
  select rep, rep from sets union select linked.a, reached.b from linked join reached on linked.b = reached.a
), classed as (
  select a as rep, min(b) as class_id from reached group by a
), counted as (
  select a as rep, count(*) as n_links from linked group by a
), named as (
  select unnest(ids) as doc_id, class_id, coalesce(n_links, 0) as n_links, copies - 1 as n_copies
  from sets join classed using (rep) left join counted using (rep)
)
select doc_id, coalesce(class_id, doc_id)::bigint as class_id, coalesce(n_links, 0)::bigint as n_links, coalesce(n_copies, 0)::bigint as n_copies
from documents left join named using (doc_id)
"""


def secrets() -> str:
    """op10: what stands between the matches of a pattern tells where they begin."""
    word = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
    names = "|".join([*map(word, ("password", "passwd", "secret", "token")), word("api") + "_?" + word("key")])
    quote = """["'']?"""
    # kind, pattern, and which of its matches count (m: the match, g: its second group)
    kinds = [
        ("assign", rf"({names}){quote}\x20*[:=]\x20*{quote}([A-Za-z0-9+/_.=-]+)", "length(g) >= 6"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
        ("hex", "[0-9a-f]+", "length(m) >= 24"),
        ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:[ \t\r\n]+[A-Za-z0-9+/=]{16,})*)", "true"),
        ("hub", r"\bgh[pousr]_[A-Za-z0-9]{36,}", "true"),
        ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
        ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "true"),
        ("login", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@]+:[^\s:/@]{3,}@[^\s/@]+", "true"),
    ]
    each = " union all ".join(
        f"select doc_id, {rank} as rank, '{kind}' as kind, start, start + length(m) as stop from ("
        f"select doc_id, m, g, list_sum([length(x) for x in before[1 : k]])::bigint + coalesce(list_sum([length(x) for x in ms[1 : k - 1]]), 0)::bigint as start "
        f"from (select doc_id, before, ms, unnest(ms) as m, unnest(gs) as g, unnest(range(1, len(ms) + 1)) as k from ("
        f"select doc_id, string_split_regex(t, '{pattern}') as before, regexp_extract_all(t, '{pattern}') as ms, "
        f"regexp_extract_all(t, '{pattern}', {2 if kind == 'assign' else 0}) as gs from texts))) where {counts}"
        for rank, (kind, pattern, counts) in enumerate(kinds)
    )
    return f"""
with texts as (select doc_id, coalesce(text, '') as t from documents
), found as ({each}
), lines as (
  select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
    count(*) filter (where kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (where rank < 3) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
  from found group by doc_id
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join lines using (doc_id)
"""


#: op12: nodes are the distinct prefixes of the rebuilt conversations; crc32 is worked out digit by digit.
TRIE = r"""
with ids as (
  select distinct conv_id from conversations where conv_id is not null
), coded as (
  select conv_id, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint) as codes from ids
), hashed as (
  select conv_id, conv_id - conv_id % 100 as base, xor(list_reduce(list_prepend(4294967295::bigint, codes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 6 as h
  from coded
), turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as at,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), heads as (
  select h.conv_id, t.at as depth, t.role, t.text from hashed h join turns t on t.conv_id = h.base and t.at <= h.h
), taken as (
  select conv_id, count(*) as k from heads group by conv_id
), rebuilt as (
  select * from heads
  union all
  select t.conv_id, t.at - h.h + coalesce(k, 0), t.role, t.text from turns t join hashed h using (conv_id) left join taken using (conv_id) where t.at > h.h
), keyed as (
  select *, md5(length(role) || ':' || role || ':' || text) as turn from rebuilt
), paths as (
  select conv_id, depth, length(text) as chars,
    md5(string_agg(turn, ',') over (partition by conv_id order by depth)) as node from keyed
), ended as (
  select ids.conv_id, coalesce(max(depth), 0) as length from ids left join paths using (conv_id) group by ids.conv_id
), every as (
  select conv_id, depth, chars, node from paths union all select conv_id, 0, 0, '' from ids
), steps as (
  select *, lag(node) over (partition by conv_id order by depth) as parent from every
), nodes as (
  select node, depth, any_value(parent) as parent, min(conv_id) as rep, count(*) as n, any_value(chars) as chars,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = length) as ends
  from steps join ended using (conv_id) group by node, depth
), counted as (
  select parent as node, count(*) as n_children from nodes where parent is not null group by parent
), valued as (
  select n.*, coalesce(n_children, 0) as n_children, (n - 1) * chars as value, (n_children is null)::int as leaf from nodes n left join counted using (node)
), summed as (
  select e.node, sum(value) as saved, sum(leaf) as leaves from valued v join every e on e.conv_id = v.rep and e.depth <= v.depth group by e.node
)
select v.rep::bigint as conv_id, v.depth::bigint as depth, p.rep::bigint as parent_conv_id, v.n::bigint as n_convs, v.n_children::bigint as n_children,
  leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
from valued v join summed using (node) left join nodes p on p.node = v.parent
"""

#: op13: all pairs of sets that share a shingle, and what the links join, by smallest id.
NEAR = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingled as (
  select doc_id, list_sort(list_distinct([array_to_string(w[i : i + {NEAR_SHINGLE - 1}], ' ') for i in range(1, greatest(len(w) - {NEAR_SHINGLE - 2}, 2))])) as s
  from words where len(w) > 0
), sets as (
  select min(doc_id) as rep, s, list(doc_id) as ids from shingled group by s
), tokens as (
  select rep, len(s) as n, unnest(s) as token from sets
), shared as (
  select x.rep as a, y.rep as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as k
  from tokens x join tokens y on x.token = y.token and x.rep < y.rep group by x.rep, y.rep
), linked as (
  select a, b from shared where 100 * k >= {PERCENT} * (n + m - k) union all select b, a from shared where 100 * k >= {PERCENT} * (n + m - k)
), reached(a, b) as (
  select rep, rep from sets union select linked.a, reached.b from linked join reached on linked.b = reached.a
), classed as (
  select a as rep, min(b) as component_id from reached group by a
), named as (
  select unnest(ids) as doc_id, component_id, len(s) as n_shingles from sets join classed using (rep)
)
select doc_id, coalesce(n_shingles, 0)::bigint as n_shingles, coalesce(component_id, doc_id)::bigint as component_id,
  doc_id = coalesce(component_id, doc_id) as kept
from documents left join named using (doc_id)
"""


def sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": SUBSTRING,
        "op6_license_scan": licenses(),
        "op7_chosen_path_join": JACCARD,
        "op10_secret_ledger": secrets(),
        "op12_conversation_trie": TRIE,
        "op13_minmax_dedup": NEAR,
    }
