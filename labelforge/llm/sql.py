"""DuckDB SQL for those training-data queries that SQL can express on whole tables."""

_TERMS = r"""with r as (select row_id, try_cast(regexp_replace(output, '^[\s\p{Z}\x1c-\x1f]+|[\s\p{Z}\x1c-\x1f]+$', '', 'g') as json) as o from sft_train),
ok as (select row_id, case when json_type(o, '$.symptoms') = 'ARRAY' then json_extract(o, '$.symptoms[*]') else [] end as items from r where json_type(o) = 'OBJECT'),
t as (select row_id, unnest(list_transform(list_filter(items, lambda v: json_type(v) = 'VARCHAR'), lambda v: v->>'$')) as term from ok),
f as (select term, count(*) as occurrences, count(distinct row_id) as records from t group by term),
terms as (select *, case when records <= 2 then 'rare' when records > 0.05 * (select count(*) from ok) then 'common' end as mark from f)
"""

SQL: dict[str, str] = {
    "p6_terms": _TERMS + "select * from terms",
    "p6_found": _TERMS + "select term, mark from terms where mark is not null",
}
