"""DuckDB SQL that states the results of the queries that SQL can express."""

from __future__ import annotations

from flamelake.llm import licenses
from flamelake.llm import quality_rules as rules
from flamelake.llm import secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _distance(p: str, q: str) -> str:
    part = f"list_sum(list_transform(list_zip({p}, {q}), lambda x: case when x[1] > 0 then x[1] * log2(2 * x[1] / (x[1] + x[2])) else 0 end))"
    return part


def quality_sql() -> str:
    text = "coalesce(text, '')"
    classes = ", ".join(
        f"length(regexp_replace({text}, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in rules.CLASSES.values()
    )
    classes = f"length({text}) - length(array_to_string(words, '')), " + classes.replace("\\u0080", "\\x{80}")
    common = ", ".join(f"len(list_filter(low, lambda x: x = '{w}'))" for w in rules.COMMON)

    def best(counts: str) -> str:
        forth, back = _distance("p.v", "r.v"), _distance("r.v", "p.v")
        return f"""
    select p.n, min(sqrt(greatest(0, ({forth} + {back}) / 2))) as far
    from (select n, list_transform({counts}, lambda x: x / list_sum({counts})) as v from m where list_sum({counts}) > 0) p,
        (select list_transform(s, lambda x: x / list_sum(s)) as v from
            (select list(t order by pos) as s from
                (select lang, pos, sum(c) as t from
                    (select lang, unnest({counts}) as c, unnest(range(1, len({counts}) + 1)) as pos from m where lang is not null)
                group by 1, 2) group by lang) where list_sum(s) > 0) r
    group by 1"""

    return f"""
with w as (
    select row_number() over () as n, doc_id, lang, {text} as body, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') as words
    from documents
),
counted as (select *, [{classes}] as classes from (select *, body as text from w)),
m as (
    select n, lang, list_concat(classes, [length(body) - list_sum(classes)]) as chars,
        list_concat(common, [len(words) - list_sum(common)]) as common
    from (select *, [{common}] as common from (select *, list_transform(words, lambda x: lower(x)) as low from counted))
),
lines as (
    select n, count(*) - count(distinct line) as dup
    from (select n, unnest(string_split(body, chr(10))) as line from w) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1
),
tri as (
    select n, i, count(*) over (partition by n, a, b, c) as times from
        (select n, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
         from (select n, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3))
),
again as (select n, count(distinct pos) as hit from (select n, unnest([i, i + 1, i + 2]) as pos from tri where times > 1) group by 1),
far_chars as ({best("chars")}),
far_words as ({best("common")}),
v as (
    select w.*, coalesce(dup, 0) as dup, coalesce(hit, 0) as hit, coalesce(c.far, 0) as c, coalesce(f.far, 0) as f,
        len(words) < {rules.MIN_WORDS} or 100 * coalesce(hit, 0) > 50 * len(words) as base
    from w left join lines using (n) left join again using (n) left join far_chars c using (n) left join far_words f using (n)
)
select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(regexp_replace(body, '[^{rules.SYMBOLS}]+', '', 'g')) as bigint) as n_symbols, dup as n_dup_lines, hit as n_repeat_words,
    round(c, 6) as char_distance, round(f, 6) as word_distance, base as base_failed,
    not base and not (length(body) >= {rules.MIN_CHARS} and c > {rules.MAX_CHAR_DISTANCE})
        and not (len(words) >= {rules.MIN_COMMON_WORDS} and f > {rules.MAX_WORD_DISTANCE}) as kept
from v
"""


def license_sql() -> str:
    names = ", ".join(f"('{key}', '{name}')" for key, name in licenses.known().items())
    steps = []
    for n, (_, rule) in enumerate(licenses.RULES):
        text = licenses.sequence(rule)
        for c in "sp":
            steps.append(f"contains({c}{n}, '{text}') as {c}_hit{n}, replace({c}{n}, '{text}', '|') as {c}{n + 1}")
    hits = "[" + ", ".join(f"case when s_hit{n} or p_hit{n} then '{name}' end" for n, (name, _) in enumerate(licenses.RULES)) + "]"
    last = len(licenses.RULES)
    cut = "select doc_id, n, '{kind}' as kind, unnest(string_split_regex(body, '{end}')) as part, generate_subscripts(string_split_regex(body, '{end}'), 1) as pos from d"
    return f"""
with known(sentence, id) as (values {names}),
d as (select row_number() over () as n, doc_id, coalesce(text, '') as body from documents),
parts as ({cut.format(kind="s", end=licenses.BY_LINE)} union all {cut.format(kind="p", end=licenses.BY_PARAGRAPH)}),
sentences as (select n, kind, pos, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) as sentence from parts),
marked as (select s.*, id from sentences s left join known using (sentence)),
seq as (
    select n, string_agg(id, ',' order by pos) filter (kind = 's') as ids,
        coalesce(string_agg('<' || id || '>', '' order by pos) filter (kind = 's'), '') as s0,
        coalesce(string_agg('<' || id || '>', '' order by pos) filter (kind = 'p'), '') as p0,
        count(*) filter (kind = 's' and id is null and regexp_matches(sentence, '{licenses.TRIGGER}')) as n_unknown
    from marked group by 1
),
m as (select *, {", ".join(steps)} from seq)
select doc_id, array_to_string(list_filter({hits}, lambda x, i: x is not null and not list_contains({hits}[: i - 1], x)), ',') as licenses, coalesce(ids, '') as sentence_ids,
    cast(length(s{last}) - length(replace(s{last}, '<', '')) as bigint) as n_unmatched, n_unknown
from d join m using (n)
"""


def secret_sql() -> str:
    """Every rule over every text: places follow from what lies between the matches."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    parts = " union all ".join(
        f"""select n, {rank} as rank, '{rule.kind}' as kind, unnest(range(len(m))) as k,
            unnest(list_transform(m, lambda x: length(x))) as own,
            unnest(list_transform(string_split_regex(body, p)[: len(m)], lambda x: length(x))) as gap,
            unnest(list_transform(regexp_extract_all(body, p, {rule.group}), lambda x: length(x))) >= {rule.least} as fits
        from (select *, regexp_extract_all(body, p) as m from (select *, {quoted(rule.pattern)} as p from d))"""
        for rank, rule in enumerate(secret_scan.RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secret_scan.BASE)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secret_scan.BASE)
    return f"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as body from documents),
cut as ({parts}),
placed as (select *, sum(own + gap) over (partition by n, rank order by k) as stop from cut),
found as (select n, rank, kind, cast(stop - own as bigint) as start, concat_ws(':', kind, cast(stop - own as bigint), cast(stop as bigint)) as span from placed where fits),
each as (
    select n, {counts}, string_agg(span, ',' order by start, rank) as every, string_agg(span, ',' order by start, rank) filter (kind in ({base})) as own
    from found group by 1
)
select doc_id, {zeros}, sha256(coalesce(own, '')) as base_sha256, coalesce(every, '') as spans from d left join each using (n)
"""


ORACLES: dict[str, str] = {
    "op13_secret_scan": secret_sql(),
    "op2_license_scan": license_sql(),
    "op10_quality_rules": quality_sql(),
    "op8_decontaminate": f"""
with d as (select doc_id, {_ITEM_WORDS} as w from documents),
b as (select item_id, {_ITEM_WORDS} as w from benchmark),
bw as (
    select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as k
    from (select *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from b where len(w) > 0)
),
dw as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as k
    from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)
),
hit as (select doc_id, item_id, i, n from dw join bw using (n, k)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
items as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
    from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by 1
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
""",
}
