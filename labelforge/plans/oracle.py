"""DuckDB SQL that gives what the queries give, on the same tables."""

from labelforge import constants


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _map(values: dict[str, str]) -> str:
    return "map([" + ", ".join(f"'{k}'" for k in values) + "], [" + ", ".join(f"'{v}'" for v in values.values()) + "])"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\x1c-\x1f]+|[\s\p{{Z}}\x1c-\x1f]+$', '', 'g')"


def _prepared(x: str, mode: str = "full") -> str:
    if mode == "strict":
        return _strip(x)
    out = _strip(f"regexp_replace({_strip(x)}, '```(?:json)?', '', 'g')")
    return out if mode == "fences" else _strip(f"replace(replace({out}, '<|im_end|>', ''), '</s>', '')")


def _object(x: str, mode: str = "full") -> str:
    j = f"try_cast({_prepared(x, mode)} as json)"
    return f"case when json_type({j}) = 'OBJECT' then {j} end"


_STRINGS = "list_transform(json_extract({o}, '$.symptoms[*]'), lambda v: v->>'$')"


def _reason(o: str) -> str:
    return f"""case when {o} is null then 'not_object'
      when list_sort(json_keys({o})) <> ['department', 'symptoms', 'urgency'] then 'bad_keys'
      when json_type({o}, '$.department') <> 'VARCHAR' or {o}->>'$.department' not in {_list(constants.DEPARTMENTS)} then 'bad_department'
      when json_type({o}, '$.urgency') <> 'VARCHAR' or {o}->>'$.urgency' not in {_list(constants.URGENCIES)} then 'bad_urgency'
      when json_type({o}, '$.symptoms') <> 'ARRAY' or json_array_length({o}, '$.symptoms') = 0 then 'bad_symptoms'
      when len(list_filter(json_extract({o}, '$.symptoms[*]'), lambda v: json_type(v) <> 'VARCHAR' or {_strip("v->>'$'")} = '')) > 0 then 'bad_symptom_item'
      else 'ok' end"""


def _label(table: str, text: str, name: str, mode: str = "full") -> str:
    """A relation with the parsed object, its reason and its parts beside the table's columns."""
    o = f"{name}_o"
    return f"""(select *, case when {name}_reason = 'ok' then {o}->>'$.department' end as {name}_department,
      case when {name}_reason = 'ok' then {o}->>'$.urgency' end as {name}_urgency,
      case when {name}_reason = 'ok' then {_STRINGS.format(o=o)} end as {name}_symptoms
      from (select *, {_reason(o)} as {name}_reason from (select *, {_object(text, mode)} as {o} from {table})))"""


def _compact(d: str, u: str, s: str) -> str:
    return f"'{{\"department\":' || to_json({d}) || ',\"urgency\":' || to_json({u}) || ',\"symptoms\":' || to_json({s}) || '}}'"


def _distinct(x: str) -> str:
    return f"[{x}[i] for i in range(1, len({x}) + 1) if list_position({x}, {x}[i]) = i]"


_BARE = "translate({x}, ' ，,。.', '')"


def _worded(xs: str) -> str:
    bare = _BARE.format(x=_strip("s"))
    return f"list_filter(list_transform({xs}, lambda s: coalesce({_map(constants.SYMPTOM_WORDING)}[{bare}], {bare})), lambda s: s <> '')"


def _jaccard(a: str, b: str) -> str:
    shown = lambda x: f"list_distinct(list_filter(list_transform(coalesce({x}, []::varchar[]), lambda s: {_strip('s')}), lambda s: s <> ''))"
    x, y = shown(a), shown(b)
    both = f"len(list_distinct(list_concat({x}, {y})))"
    return f"case when {both} = 0 then 1.0 else (len({x}) + len({y}) - {both})::double / {both} end"


_RAW = "(select raw_id, source_file, row_idx, input, output from teacher_raw)"
_FILE_NO = "case source_file " + " ".join(f"when '{f}' then {i}" for i, f in enumerate(constants.RAW_FILES)) + f" else {len(constants.RAW_FILES)} end"

_NORMALISED = f"""
n0 as (select *, {_FILE_NO} as file_no, {_strip('input')} as clean_input, {_object('output')} as o from {_RAW}),
n1 as (select *, case when json_type(o, '$.department') = 'VARCHAR' then {_strip("o->>'$.department'")} end as typed,
    case when json_type(o, '$.urgency') = 'VARCHAR' then {_strip("o->>'$.urgency'")} end as clean_urgency,
    list_contains(json_keys(o), 'department') and list_contains(json_keys(o), 'urgency') and list_contains(json_keys(o), 'symptoms') as has_keys,
    case when json_type(o, '$.symptoms') = 'ARRAY' then json_extract(o, '$.symptoms[*]') end as items from n0),
n2 as (select *, coalesce({_map(constants.RENAMED_DEPARTMENTS)}[typed], typed) as clean_department,
    list_filter(list_transform(items, lambda v: {_strip("v->>'$'")}), lambda s: s <> '') as shown,
    len(list_filter(items, lambda v: json_type(v) <> 'VARCHAR')) > 0 as odd from n1),
n3 as (select *, case when not odd and len(shown) > 0 then {_distinct('shown')} end as clean_symptoms from n2),
n4 as (select *, case when coalesce(clean_input, '') <> '' and o is not null and has_keys and typed <> clean_department then 'map_department:' || typed || '->' || clean_department end as rename,
    case when coalesce(clean_input, '') = '' then 'drop_bad_input' when o is null then 'drop_bad_json' when not has_keys then 'drop_missing_keys'
      when typed is null then 'drop_bad_department_type' when clean_department in {_list(constants.DROPPED_DEPARTMENTS)} then 'drop_department:' || clean_department
      when clean_department not in {_list(constants.DEPARTMENTS)} then 'drop_unknown_department:' || clean_department
      when clean_urgency is null or clean_urgency not in {_list(constants.URGENCIES)} then 'drop_bad_urgency' when clean_symptoms is null then 'drop_bad_symptoms' end as drop_reason from n3),
normalised as (select *, case when drop_reason is null then {_compact('clean_department', 'clean_urgency', 'clean_symptoms')} end as clean_output,
    row_number() over (order by file_no, source_file, row_idx, raw_id) as place from n4),
kept as (select *, first_value(clean_output) over (partition by clean_input order by place) as first_output, row_number() over (partition by clean_input order by place) as rn from normalised where drop_reason is null),
clean as (select * from kept where rn = 1)"""

_SCORED = f"""
g as (select * from {_label('predictions', 'gold', 'gold')}),
scored as (select *, pred_reason = 'ok' and gold_department = pred_department as dept_ok, pred_reason = 'ok' and gold_urgency = pred_urgency as urgency_ok,
    coalesce(pred_urgency, 'BAD_ANSWER') as pred_label, pred_o is not null as pred_parsed from {_label('g', 'response', 'pred')}),
good as (select * from scored where gold_reason = 'ok')"""

_GREEDY = """list_reduce(p, lambda a, x: struct_pack(h := a.h + case when len([i for i in range(1, len(g) + 1) if {fits}]) > 0 then 1 else 0 end,
    used := case when len([i for i in range(1, len(g) + 1) if {fits}]) > 0 then list_append(a.used, [i for i in range(1, len(g) + 1) if {fits}][1]) else a.used end), struct_pack(h := 0, used := []::bigint[])).h""".format(
    fits="not list_contains(a.used, i) and (g[i] = x or (length(g[i]) >= 2 and length(x) >= 2 and (contains(g[i], x) or contains(x, g[i]))))"
)
_WORDED = f"""
w0 as (select pred_id, {_worded('gold_symptoms')} as g1, {_worded('pred_symptoms')} as p1 from good where pred_reason = 'ok'),
w1 as (select pred_id, {_distinct('g1')} as g, {_distinct('p1')} as p, g1, p1 from w0),
w2 as (select *, {_GREEDY}::double as h from w1),
worded as (select *, case when len(g) = 0 and len(p) = 0 then 1.0 when h = 0 then 0.0 else 2 * (h / len(p)) * (h / len(g)) / (h / len(p) + h / len(g)) end as f1,
    case when len(g) = 0 and len(p) = 0 then 1.0 when len(g) + len(p) - h = 0 then 0.0 else h / (len(g) + len(p) - h) end as j from w2)"""


def _rate(part: str, whole: str) -> str:
    return f"coalesce(round(({part})::double / nullif({whole}, 0), 6), 0.0)"


def _f1(u: str) -> str:
    return f"coalesce(2.0 * count_if(gold_urgency = '{u}' and pred_label = '{u}') / nullif(count_if(gold_urgency = '{u}') + count_if(pred_label = '{u}'), 0), 0.0)"


_MACRO = f"round(({' + '.join(_f1(u) for u in constants.URGENCIES)}) / 3, 6)"


def _report(gold: str, pred: str, labels: list[str]) -> str:
    return f"""with {_SCORED}, v as (select {gold} as g, {pred} as p from good where pred_reason = 'ok'),
s as (select l as label, (select count(*) from v where g = l and p = l) as tp, (select count(*) from v where g = l) as support, (select count(*) from v where p = l) as predicted
    from (select unnest([{', '.join(f"'{x}'" for x in labels)}]) as l)),
r as (select *, coalesce(tp / nullif(predicted, 0), 0.0) as precision, coalesce(tp / nullif(support, 0), 0.0) as recall, coalesce(2.0 * tp / nullif(predicted + support, 0), 0.0) as f1 from s where support + predicted > 0)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from r
union all select 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::bigint from r
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from r
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from r"""


def _confusion(gold: str, pred: str, labels: list[str], where: str) -> str:
    axis = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    return f"""with {_SCORED} select a.l as gold, b.l as pred, count(s.pred_id) as n from (select unnest({axis}) as l) a cross join (select unnest({axis}) as l) b
left join (select * from good where {where}) s on s.{gold} = a.l and s.{pred} = b.l group by all"""


def _errors(every: bool) -> str:
    given, out = f"coalesce({_strip('output')}, '') <> ''", "o"
    blank = lambda c: f"coalesce({_strip(c)}, '') = ''"
    first = f"case when {blank('instruction')} then 'bad_instruction' end, case when {blank('input')} then 'bad_input' end, case when not ({given}) then 'bad_output_text' end, case when contains(output, '```') then 'markdown_fence_in_output' end"
    if every:
        rest = f"""case when {given} and o is null then 'output_not_object' end,
        case when o is not null and list_sort(json_keys(o)) <> ['department', 'symptoms', 'urgency'] then 'bad_output_keys' end,
        case when o is not null and not coalesce(json_type(o, '$.department') = 'VARCHAR' and o->>'$.department' in {_list(constants.DEPARTMENTS)}, false) then 'bad_department' end,
        case when o is not null and not coalesce(json_type(o, '$.urgency') = 'VARCHAR' and o->>'$.urgency' in {_list(constants.URGENCIES)}, false) then 'bad_urgency' end,
        case when o is not null and not coalesce(json_type(o, '$.symptoms') = 'ARRAY' and json_array_length(o, '$.symptoms') > 0, false) then 'bad_symptoms' end,
        case when json_type(o, '$.symptoms') = 'ARRAY' and len(list_filter(json_extract(o, '$.symptoms[*]'), lambda v: json_type(v) <> 'VARCHAR' or {_strip("v->>'$'")} = '')) > 0 then 'bad_symptom_item' end"""
    else:
        rest = f"case when {given} and ({_reason(out)}) <> 'ok' then ({_reason(out)}) end"
    return f"(select row_id, list_filter([{first}, {rest}], lambda e: e is not null) as errors, * exclude (row_id) from (select *, {_object('output', 'strict' if every else 'full')} as o from sft_train))"


_DIFFS = f"""
d0 as (select pair_id, _source, conversations, chosen.value as chosen_text, rejected.value as rejected_text from dpo_train_2),
d1 as (select * from {_label('d0', 'chosen_text', 'chosen')}),
d2 as (select * from {_label('d1', 'rejected_text', 'rejected')}),
diffs as (select *, coalesce({_strip('rejected_text')}, '') = '' as missing,
    case when chosen_reason = 'ok' and rejected_reason = 'ok' then coalesce(nullif(concat_ws('+', case when chosen_department <> rejected_department then 'department' end, case when chosen_urgency <> rejected_urgency then 'urgency' end, case when chosen_symptoms <> rejected_symptoms then 'symptoms' end), ''), 'no_diff') end as diff from d2)"""


def _draw(use: str) -> str:
    return f"(('0x' || substr(md5('42|{use}|' || row_id::varchar), 1, 8))::bigint / 4294967296.0)"


_PRED_PAIRS = f"""
pp as (select pred_id, input, {_compact('gold_department', 'gold_urgency', 'gold_symptoms')} as chosen,
    case when pred_reason <> 'ok' then response when gold_department <> pred_department or gold_urgency <> pred_urgency or {_jaccard('gold_symptoms', 'pred_symptoms')} < 0.5 then {_compact('pred_department', 'pred_urgency', 'pred_symptoms')} end as rejected
    from good where response is not null),
made as (select * from pp where rejected is not null)"""

_PAIRED = f"""
own as (select *, case when json_type(gold_o, '$.department') = 'VARCHAR' then gold_o->>'$.department' end as gd, case when json_type(gold_o, '$.urgency') = 'VARCHAR' then gold_o->>'$.urgency' end as gu from scored),
once as (select *, coalesce(pred_reason = 'ok' and gd = pred_department, false) as dok, coalesce(pred_reason = 'ok' and gu = pred_urgency, false) as uok from (select *, row_number() over (partition by run_name, idx order by pred_id) as rn from own) where rn = 1),
pairs as (select a.idx, a.input as input_a, b.input as input_b, a.dok and a.uok as ok_a, b.dok and b.uok as ok_b, a.pred_label as urgency_a, b.pred_label as urgency_b, a.uok as uok_a, b.uok as uok_b, a.gu as gold_a
    from once a join once b on a.idx = b.idx and a.run_name = 'base' and b.run_name = 'grpo_a')"""

_URGENCY_SCORE = "case gu || '>' || pu " + " ".join(f"when '{k}' then {v}" for k, v in constants.URGENCY_SCORE.items()) + " else 0.0 end"

SQL: dict[str, str] = {
    "json_gate_reasons": f"select source_file, label_reason as reason, count(*) as n from {_label(_RAW, 'output', 'label')} group by all",
    "parse_mode_matrix": f"select {_object('output')} is not null as \"full\", {_object('output', 'fences')} is not null as fences, {_object('output', 'strict')} is not null as strict, count(*) as n from teacher_raw group by all",
    "label_fields": f"select row_id, label_department as department, label_urgency as urgency, array_to_string(label_symptoms, '|') as symptoms from {_label('sft_train', 'output', 'label')} where label_reason = 'ok'",
    "object_keys": f"""select array_to_string(list_sort(k), ',') as keys, array_to_string(list_sort(list_filter(['department', 'urgency', 'symptoms'], lambda x: not list_contains(k, x))), ',') as missing,
array_to_string(list_sort(list_filter(k, lambda x: not list_contains(['department', 'urgency', 'symptoms'], x))), ',') as extra, count(*) as n
from (select json_keys({_object('output')}) as k from teacher_raw) where k is not null group by all""",
    "schema_symptom_lists": f"with {_NORMALISED} select raw_id, array_to_string(clean_symptoms, '|') as symptoms from normalised where items is not null",
    "worded_symptoms": f"select symptom, count(*) as n from (select unnest({_worded('label_symptoms')}) as symptom from {_label('sft_train', 'output', 'label')} where label_reason = 'ok') group by all",
    "clean_rows": f"with {_NORMALISED} select raw_id, clean_input, clean_output from clean",
    "clean_drop_stats": f"""with {_NORMALISED} select stat, count(*) as n from (select 'source_rows:' || source_file as stat from normalised union all select rename from normalised union all select drop_reason from normalised) where stat is not null group by all
union all select 'drop_duplicate_input', count(*) from kept where rn > 1 union all select 'duplicate_output_conflicts', count(*) from kept where rn > 1 and clean_output <> first_output""",
    "dedup_conflicts": f"with {_NORMALISED} select clean_input, count(*) - 1 as duplicates, count_if(clean_output <> first_output) as conflicts from kept group by clean_input having count(*) > 1",
    "hash_split": f"with {_NORMALISED} select raw_id, case when row_number() over (order by md5('42|' || clean_input), raw_id) <= greatest(1, round_even((select count(*) from clean) * 0.1::double, 0)) then 'valid' else 'train' end as split from clean",
    "label_distribution": f"""with {_NORMALISED} select 'department' as field, clean_department as value, count(*) as n, row_number() over (order by count(*) desc, min(place)) as rank from clean group by clean_department
union all select 'urgency', clean_urgency, count(*), row_number() over (order by count(*) desc, min(place)) from clean group by clean_urgency""",
    "clean_report": f"""with {_NORMALISED} select (select count(*) from normalised) as source_rows, (select count(drop_reason) from normalised) as dropped, (select count(rename) from normalised) as renamed,
count_if(rn > 1) as duplicates, count_if(rn > 1 and clean_output <> first_output) as conflicts, count_if(rn = 1) as num_clean_rows from kept""",
    "document_first_wins": "select min(doc_id) as doc_id, md5(text) as text_md5 from documents where text is not null group by text",
    "sft_row_errors": f"select error, count(*) as n from (select unnest(errors) as error from {_errors(False)}) group by all",
    "sft_row_errors_all": f"select error, count(*) as n from (select unnest(errors) as error from {_errors(True)}) group by all",
    "sft_error_preview": f"select row_id, unnest(range(0, len(errors)))::int as seq, unnest(errors) as error from {_errors(False)} order by row_id, seq limit 50",
    "duplicate_inputs": "select substr(input, 1, 200) as input, n from (select input, count(*) as n from sft_train where input is not null group by input having count(*) > 1)",
    "validation_report": f"""with e as (select *, coalesce({_strip('input')}, '') <> '' as asked, ({_reason('o')}) = 'ok' as valid from {_errors(False).replace('from sft_train', 'from sft_valid')}),
rep as (select split_name, count(*) as repeated from (select split_name, input from e where asked group by split_name, input having count(*) > 1) group by split_name),
d as (select split_name, field, string_agg(value || ':' || n, ',' order by n desc, pos) as dist from (select split_name, 'd' as field, o->>'$.department' as value, count(*) as n, min(row_id) as pos from e where valid group by all
    union all select split_name, 'u', o->>'$.urgency', count(*), min(row_id) from e where valid group by all) group by split_name, field),
s as (select split_name, count(*) as num_rows, sum(len(errors)) as errors from e group by split_name)
select s.split_name, num_rows, (errors + coalesce(repeated, 0))::bigint as num_errors, coalesce(repeated, 0) as repeated_inputs, errors + coalesce(repeated, 0) = 0 as passed, coalesce(a.dist, '') as department_distribution, coalesce(b.dist, '') as urgency_distribution
from s left join rep on s.split_name is not distinct from rep.split_name left join d a on a.split_name is not distinct from s.split_name and a.field = 'd' left join d b on b.split_name is not distinct from s.split_name and b.field = 'u'""",
    "validation_error_preview": f"""with e as (select *, coalesce({_strip('input')}, '') <> '' as asked from {_errors(False).replace('from sft_train', 'from sft_valid')}),
x as (select split_name, row_id as pos, row_id, unnest(range(0, len(errors))) as seq, unnest(errors) as error, substr(output, 1, 200) as value from e
    union all select split_name, min(row_id), null, 0, 'duplicate_input', substr(input, 1, 200) from e where asked group by split_name, input having count(*) > 1)
select * from (select split_name, row_number() over (partition by split_name order by error = 'duplicate_input', pos, seq) as place, row_id, error, value from x) where place <= 50""",
    "pair_validation_diffs": f"""with {_DIFFS} select concat_ws(',', case when coalesce(len(conversations), 0) < 2 then 'bad_conversations' end, case when missing then 'bad_rejected_text' end, case when not missing and chosen_reason <> 'ok' then 'bad_chosen:' || chosen_reason end) as errors,
case when not missing and rejected_o is null then 'rejected_not_json' when not missing and rejected_reason <> 'ok' then 'rejected_schema:' || rejected_reason end as warning, diff, count(*) as n from diffs group by all""",
    "hard_pair_filter": f"""with {_DIFFS}, f as (select _source, case when diff is null then 'parse_error' when chosen_department <> rejected_department and chosen_urgency <> rejected_urgency then 'dept+urgency'
when chosen_department <> rejected_department then 'dept' when chosen_urgency <> rejected_urgency then 'urgency' else 'symptom_only' end as filter_reason from diffs)
select _source, filter_reason, filter_reason in ('dept', 'urgency', 'dept+urgency') as keep, count(*) as n from f group by all""",
    "synthetic_pairs": f"""with v as (select row_id, label_department as d, label_urgency as u, label_symptoms as s, {_draw('kind')} as r, {_draw('flip')} as fl, {_draw('drop')} as dr from {_label('sft_train', 'output', 'label')} where label_reason = 'ok'),
k as (select *, case when r < 0.4 then 1 when r < 0.7 then 2 else 3 end as kind from v)
select row_id, {_compact('d', 'u', 's')} as chosen, {_compact(f"case when kind = 1 then {_map(constants.CONFUSABLE)}[d] else d end", "case when kind <> 2 then u when u = '高' then '低' when u = '低' then '高' when fl < 0.5 then '高' else '低' end", "case when kind = 3 and len(s) >= 2 then [s[i] for i in range(1, len(s) + 1) if i <> floor(dr * len(s))::int + 1] else s end")} as rejected from k""",
    "prediction_error_pairs": f"with {_SCORED}, {_PRED_PAIRS} select pred_id, chosen, rejected from made",
    "pair_union_dedup": f"""with {_SCORED}, {_PRED_PAIRS}, u as (select 0 as source_no, pair_id as id, conversations::varchar as c, _source from dpo_train_2
union all select 1, pred_id, [{{'from': 'system', 'value': '{constants.STRONG_PROMPT}'}}, {{'from': 'user', 'value': coalesce(input, '')}}]::varchar, 'prediction_errors' from made)
select source_no, _source, count(*) as n from (select *, row_number() over (partition by c order by source_no, id) as rn from u) where rn = 1 group by all""",
    "grpo_records": "select row_id, coalesce(instruction, '') || chr(10) || coalesce(input, '') as prompt, coalesce(output, '') as output, coalesce(input, '') as input from sft_train",
    "chat_messages": f"select row_id, coalesce(instruction, '{constants.STRONG_PROMPT}') as system, coalesce(input, '') as user, 2::int as messages from sft_train",
    "hard_jaccard_scores": f"with {_SCORED} select pred_id, round({_jaccard('gold_symptoms', 'pred_symptoms')}, 6) as jaccard, case when pred_symptoms is null then 0.0 else round({_jaccard('gold_symptoms', 'pred_symptoms')}, 6) end as jaccard_strict from good",
    "worded_symptom_scores": f"with {_SCORED}, {_WORDED} select pred_id, round(f1, 6) as f1, round(j, 6) as jaccard from worded",
    "prediction_metrics": f"""with {_SCORED}, {_WORDED}, m as (select good.*, f1, j, case when pred_reason = 'ok' then {_jaccard('gold_symptoms', 'pred_symptoms')} end as hj from good left join worded using (pred_id))
select run_name, count(*) as num_evaluated, {_rate('count_if(pred_parsed)', 'count(*)')} as json_parse_rate, {_rate("count_if(pred_reason = 'ok')", 'count(*)')} as schema_valid_rate,
{_rate('count_if(dept_ok)', "count_if(pred_reason = 'ok')")} as department_accuracy, {_rate('count_if(urgency_ok)', "count_if(pred_reason = 'ok')")} as urgency_accuracy, {_rate('count_if(dept_ok and urgency_ok)', 'count(*)')} as e2e_accuracy, {_MACRO} as urgency_macro_f1,
{_rate("count_if(gold_urgency = '高' and pred_label = '高')", "count_if(gold_urgency = '高')")} as high_urgency_recall, count_if(gold_urgency = '高') as high_urgency_total, count_if(gold_urgency = '高' and pred_label = '中') as high_to_medium,
count_if(gold_urgency = '高' and pred_label = '低') as high_to_low, count_if(gold_urgency = '高' and pred_label = 'BAD_ANSWER') as high_to_bad, coalesce(round(avg(hj), 6), 0.0) as hard_jaccard, coalesce(round(avg(f1), 6), 0.0) as worded_f1, coalesce(round(avg(j), 6), 0.0) as worded_jaccard from m group by run_name""",
    "prediction_counters": f"""with {_SCORED} select counter, count(*) as n from (select 'evaluated' as counter from good union all select case when pred_parsed then 'json_parse_ok' else 'json_parse_error' end from good
union all select case when pred_reason = 'ok' then 'schema_valid' else 'schema_error:' || pred_reason end from good union all select 'skip_bad_gold:' || gold_reason from scored where gold_reason <> 'ok') group by all""",
    "macro_f1_valid_only": f"""with {_SCORED}, v as (select run_name, {_MACRO} as macro_f1_valid from good where pred_reason = 'ok' group by run_name) select run_name, {_MACRO} as macro_f1_all, any_value(v.macro_f1_valid) as macro_f1_valid from good join v using (run_name) group by run_name""",
    "classification_report_urgency": _report("gold_urgency", "pred_urgency", constants.URGENCIES),
    "classification_report_department": _report("gold_department", "pred_department", constants.DEPARTMENTS),
    "confusion_urgency": _confusion("gold_urgency", "pred_label", [*constants.URGENCIES, "BAD_ANSWER"], "true"),
    "confusion_department": _confusion("gold_department", "pred_department", constants.DEPARTMENTS, "pred_reason = 'ok'"),
    "paired_comparison": f"""with {_SCORED}, {_PAIRED} select count(*) as num_compared, count_if(input_a is distinct from input_b) as input_mismatch, count_if(ok_a and ok_b) as both_correct, count_if(not ok_a and not ok_b) as both_wrong, count_if(not ok_a and ok_b) as improved, count_if(ok_a and not ok_b) as regressed,
count_if(not ok_a and ok_b) - count_if(ok_a and not ok_b) as net_e2e, count_if(not uok_a and uok_b) as urgency_fixed, count_if(uok_a and not uok_b) as urgency_broken, count_if(gold_a = '高') as high_total, count_if(gold_a = '高' and urgency_a = '高') as high_hit_a,
count_if(gold_a = '高' and urgency_b = '高') as high_hit_b, count_if(gold_a = '高' and urgency_a = '低') as high_to_low_a, count_if(gold_a = '高' and urgency_b = '低') as high_to_low_b from pairs""",
    "top_regressions": f"with {_SCORED}, {_PAIRED} select idx, input_a as input, urgency_a, urgency_b from pairs where ok_a and not ok_b order by idx limit 20",
    "reward_scores": f"""with {_SCORED}, {_WORDED}, r as (select s.pred_id, gold_reason, pred_reason, pred_parsed, gold_department = pred_department as dept, gold_urgency as gu, pred_urgency as pu, f1, g1, p1, contains(response, '```') as fenced from scored s left join worded using (pred_id))
select pred_id, round(case when gold_reason <> 'ok' then 0.0 when not pred_parsed then -1.0 when pred_reason <> 'ok' then -0.5 else greatest(-1.0, least(1.0,
  0.05::double * (case when fenced then 0.8 else 1.0 end) + 0.25::double * dept::int + 0.30::double * ({_URGENCY_SCORE}) + 0.40::double * f1
  - (case when len(p1) <> len(list_distinct(p1)) then 0.05 else 0 end) - (case when len(p1) > greatest(6, len(g1) + 3) then 0.05 else 0 end) - (case when fenced then 0.05 else 0 end)
  - (case when gu = '高' and pu = '低' then 0.4 when gu = '高' and pu = '中' then 0.1 else 0 end))) end::double, 6) as reward from r""",
    "semantic_soft_jaccard": """with e as (select vec_id // 8 as set_id, vec_id, embedding::double[] as v, vec_id % 8 as k from embeddings),
s as (select g.set_id, p.vec_id as p, g.vec_id as g, list_cosine_similarity(p.v, g.v) as sim from e g join e p on g.set_id = p.set_id and g.k < 4 and p.k >= 4),
b as (select * from (select *, row_number() over (partition by set_id, p order by sim desc, g) as rn from s) where rn = 1),
h as (select set_id, count(distinct g) as hits from b where sim >= 0.1 group by set_id),
n as (select set_id, count_if(k < 4) as golds, count_if(k >= 4) as preds from e group by set_id)
select set_id::bigint as set_id, golds, preds, coalesce(hits, 0) as hits, round(coalesce(hits, 0)::double / (golds + preds - coalesce(hits, 0)), 6) as soft_jaccard from n left join h using (set_id)""",
}


def _bigint(sql: str, columns: str) -> str:
    """Counts by condition are HUGEINT in DuckDB; the queries give BIGINT."""
    return f"select * replace ({', '.join(f'{c}::bigint as {c}' for c in columns.split())}) from ({sql})"


SQL["duplicate_inputs_top"] = SQL["duplicate_inputs"] + " order by n desc, input limit 20"
SQL["synthetic_pairs_sample"] = f"select * from ({SQL['synthetic_pairs']}) order by md5('42|' || row_id::varchar), row_id limit 1000"

for _name, _columns in {
    "dedup_conflicts": "conflicts",
    "clean_report": "duplicates conflicts num_clean_rows",
    "prediction_metrics": "high_urgency_total high_to_medium high_to_low high_to_bad",
    "paired_comparison": "input_mismatch both_correct both_wrong improved regressed net_e2e urgency_fixed urgency_broken high_total high_hit_a high_hit_b high_to_low_a high_to_low_b",
    "semantic_soft_jaccard": "golds preds",
}.items():
    SQL[_name] = _bigint(SQL[_name], _columns)
