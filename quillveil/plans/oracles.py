"""SQL for DuckDB that gives the same rows as the queries of the same name; written apart from the Spark expressions."""

from __future__ import annotations

from quillveil.operators.dates import MONTHS

_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_DATE = r"\d{1,2}[./]\d{1,2}[./]\d{2,4}"
_STOP = {
    "en": "the and of to is in you for that with are this have not was",
    "fr": "le la les et des est une pour dans que vous du au pas nous",
    "es": "el los las y del una para con que por es lo su al mi",
    "pt": "o os as e do da uma para com que não em está na se",
    "de": "der die das und ist nicht ein eine für mit den wir zu auf ich",
}


def _clean(c: str) -> str:
    return rf"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> ''), chr(10))"


def _sentences(c: str) -> str:
    return rf"""list_filter(string_split(regexp_replace({c}, '([.!?]+["'')»”’\]]*)[ \t]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"""


def _emails(c: str) -> str:
    """RE2's word bounds know ASCII only, so they are spelled out; a second pass finds what shares a bound with the first."""
    w = r"[^\pL\pN_]"
    for _ in range(2):
        c = rf"regexp_replace({c}, '(?:(^|{w})[a-zA-Z0-9_]|([\pL\pN_])[.%+-])[a-zA-Z0-9._%+-]*@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}($|{w})', '\1\2[email]\3', 'g')"
    return c


def _words(c: str) -> str:
    return rf"list_filter(string_split(regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g'), ' '), lambda w: regexp_replace(w, '{_WS}', '', 'g') <> '')"


_DIGITS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"
_HTML = r"""case when regexp_matches(content, '<[A-Za-z!/][^>]*>') then replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(content, '(?s)<!--.*?-->', '', 'g'),
        '(?si)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') else content end"""
_LINES = "(select row_id, generate_subscripts(string_split(message, chr(10)), 1) - 1 as line_no, unnest(string_split(message, chr(10))) as line from sample_data where message is not null)"
_STRIPPED = rf"regexp_replace(line, '[^\pL\pN\t-\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')"
_ONLY_NUMBERS = rf"regexp_full_match(regexp_replace({_STRIPPED}, '{_WS}', '', 'g'), '[\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]+')"
_ONLY_EMAILS = f"len(list_filter({_words('line')}, lambda w: not contains(w, '@'))) = 0"
_LINK = r"(https?|s?ftps?|scp)://(([A-Za-z0-9-]+\.)+[A-Za-z]{2,})(:\d+)?(/[^\n]*)?"
_ONLY_LINKS = f"len(list_filter({_words('line')}, lambda w: not regexp_full_match(w, '{_LINK}'))) = 0"
_ENTITIES = "(select distinct * from entity_list)"
_TOKENS = r"(select record_id, unnest(regexp_split_to_array(content, '[^\pL''’\-]+')) as token from email_records)"
_FOUND = f"(select record_id, token, g.entity_group, count(*) as n from {_TOKENS} join (select distinct word, entity_group from gazetteer) g on token = g.word where token <> '' group by all)"
_HITS = ", ".join(f"{{'n': len(list_filter(ws, lambda w: list_contains(string_split('{v}', ' '), w))), 'r': {-k}, 'lang': '{lang}'}}" for k, (lang, v) in enumerate(_STOP.items()))


def _strict_dates(c: str) -> str:
    """What looks around in the grammar is consumed here, outside of the group that is taken."""
    month = "(?:" + "|".join(sorted(set(MONTHS), key=lambda w: (-len(w), w))) + r")\b\.?"
    day, number = "(?:3[01]|[12][0-9]|0?[1-9])", "(?:1[0-2]|0?[1-9])"
    date = rf"(?:\b{day}\.?\s+{month}\s+\d{{4}}\b|\b{month}\s+{day}(?:st|nd|rd|th)?,?\s+\d{{4}}\b|\b\d{{4}}[-/]{number}[-/]{day}|(?:{day}[./]{number}|{number}[./]{day})[./](?:\d{{4}}|\d{{2}}))"
    gap = r"(?:\s*(?:[,.\-]|\b(?:a las|at|um|le|the|el)\b|à)\s*|\s+){1,2}"
    hour = "(?:2[0-3]|[01]?[0-9])"
    clock = rf"{hour}:[0-5]\d(?::[0-5]\d)?"
    # A bare hour needs a blank before it.
    return rf"""list_transform(regexp_extract_all({c}, '(?i)(?:^|[^\d./])({date}{gap}{clock}(?:\s+[+\-]\d{{4}})?(?:[^\d:]|$)|{date}{gap}{hour}\.[0-5]\d(?:[^\d.]|$)|{date}[ \t]+{hour}(?:[^\w:$%€£.,/\s-]|[.,/-](?:\D|$)|\s(?:\D|$)|$))', 1),
        lambda x: regexp_extract(x, '(?i)^((?:.|\n)*?(?:{gap}(?:{clock}(?:\s+[+\-]\d{{4}})?|{hour}\.[0-5]\d)|[ \t]+{hour}))[^0-9]{{0,2}}$', 1))"""


def _scores(counts: str) -> str:
    return f"""select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0), 6) as precision,
        round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 6) as recall, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6) as f1,
        round(avg(case when fp = 0 and fn = 0 then 1.0 else 0.0 end), 6) as exact from ({counts})"""


SQL: dict[str, str] = {
    "mask_pipeline": rf"select doc_id, array_to_string(list_transform({_sentences(_clean('text'))}, lambda s: regexp_replace({_emails('s')}, '[\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]+', '[number]', 'g')), ' ') as pseudo_text from documents where text is not null",
    "clean_text": f"select row_id, {_clean('message')} as cleaned from sample_data where message is not null",
    "sentence_split": f"select doc_id, (generate_subscripts(s, 1) - 1)::int as sent_idx, unnest(s) as sentence from (select doc_id, {_sentences('text')} as s from documents where text is not null)",
    "sentence_histogram": f"select len({_sentences('text')})::int as n_sentences, count(*) as n from documents where text is not null group by 1",
    "email_mask": f"select record_id, {_emails('content')} as masked from email_records",
    "email_extract": rf"select record_id, (generate_subscripts(x, 1) - 1)::int as idx, unnest(x) as email from (select record_id, regexp_extract_all(content, '\b{_EMAIL}\b') as x from email_records)",
    "sentences_after_email": f"select record_id, (generate_subscripts(s, 1) - 1)::int as sent_idx, unnest(s) as sentence from (select record_id, list_transform({_sentences(_clean('content'))}, lambda x: {_emails('x')}) as s from email_records)",
    "number_mask": r"select doc_id, regexp_replace(text, '[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]+', '[number]', 'g') as masked from documents where text is not null",
    "number_mask_dates": rf"select doc_id, replace(replace(replace(regexp_replace(text, '({_DATE})|[\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]+', chr(1) || '\1' || chr(2), 'g'), chr(1) || chr(2), '[number]'), chr(1), ''), chr(2), '') as masked from documents where text is not null",
    "date_find": f"select doc_id, (generate_subscripts(x, 1) - 1)::int as idx, unnest(x) as found from (select doc_id, regexp_extract_all(text, '{_DATE}') as x from documents where text is not null)",
    "dates_strict": f"select row_id, (generate_subscripts(x, 1) - 1)::int as idx, unnest(x) as phrase from (select row_id, {_strict_dates('message')} as x from sample_data where message is not null)",
    "gazetteer_words": r"""with g as (select word, max(entity_group) as entity_group from gazetteer where trim(word) <> '' group by 1),
        p as (select '(?:^|[^\pL\pN\pM])(' || string_agg(regexp_replace(regexp_escape(word), '(\\[^\pL\pN\pM]|[^\pL\pN\pM\\])', '\1\1', 'g'), '|' order by length(word) desc, word) || ')(?:$|[^\pL\pN\pM])' as pattern from g),
        x as (select record_id, regexp_extract_all(regexp_replace(content, '([^\pL\pN\pM])', '\1\1', 'g'), (select pattern from p), 1) as hits from email_records)
        select record_id, k::int as k, g.word, entity_group from (select record_id, generate_subscripts(hits, 1) - 1 as k, regexp_replace(unnest(hits), '([^\pL\pN\pM])[^\pL\pN\pM]', '\1', 'g') as word from x) h join g using (word)""",
    "strip_punctuation": _STRIPPED.replace("line", "text").join(("select doc_id, ", r" as stripped, not regexp_matches(text, '[\pL\pN]') as only_punct from documents where text is not null")),
    "only_numbers_flags": f"select row_id, line_no::int as line_no, {_ONLY_NUMBERS} as flag from {_LINES}",
    "only_emails_flags": f"select row_id, line_no::int as line_no, {_ONLY_EMAILS} as flag from {_LINES}",
    "link_flags": rf"select row_id, word, regexp_full_match(word, '{_LINK}') as flag, count(*) as n from (select row_id, unnest(regexp_split_to_array(message, '\s+')) as word from sample_data) where contains(word, '://') group by all",
    "lang_guard": rf"select row_id, line_no::int as line_no, regexp_replace(line, '{_WS}', '', 'g') <> '' and regexp_matches(line, '[\pL\pN]') and not {_ONLY_NUMBERS} and not ({_ONLY_EMAILS}) and not ({_ONLY_LINKS}) as flag from {_LINES}",
    "lang_stopword": rf"""select doc_id, case when best.n > 0 then best.lang end as lang, round(case when best.n > 0 then best.n / total else 0.0 end, 6) as prob from (
        select doc_id, list_max(h) as best, list_sum(list_transform(h, lambda x: x.n)) as total from (select doc_id, [{_HITS}] as h from (select doc_id, regexp_split_to_array(lower(text), '[^\pL]+') as ws from documents where text is not null)))""",
    "lang_runs": """with x as (select coalesce(sender, '') as sender, row_id, language, lag(language) over w as before, row_number() over w as k from sample_data window w as (partition by coalesce(sender, '') order by row_id)),
        y as (select *, sum(case when k = 1 or language is distinct from before then 1 else 0 end) over (partition by sender order by row_id) as run from x)
        select sender, min(row_id) as begin_id, max(row_id) + 1 as end_id, any_value(language) as lang from y group by sender, run""",
    "model_resolution": "select doc_id, case when lang = 'gl' then 'pt' when lang in ('en','fr','es','pt','de','it','ru','zh','ja') then lang else 'de' end as model_lang from documents",
    "field_skip": "select row_id, coalesce(subject not in ('', 'unmatched'), false) as subject_used, coalesce(message not in ('', 'unmatched'), false) as message_used from sample_data",
    "csv_mapping": "select message as content, 'unmatched' as date, subject as title, row_id from sample_data",
    "html_text": f"select record_id, {_HTML} as bare from email_records",
    "pipeline_masks": rf"""with c as (select record_id, {_clean(_HTML)} as t from email_records where content is not null and content not in ('', 'unmatched')), x as (select record_id, t, {_strict_dates('t')} as dates, {_sentences('t')} as s from c),
        p as (select *, case when len(dates) = 0 then '(\x{{03}})' else '(' || array_to_string(list_transform(list_reverse_sort(list_transform(dates, lambda d: {{'n': length(d), 'd': d}})), lambda y: regexp_escape(y.d)), '|') || ')' end || '|{_DIGITS}+' as pattern from x),
        m as (select record_id, dates, s, list_transform(s, lambda y: regexp_replace({_emails('y')}, pattern, chr(1) || '\1' || chr(2), 'g')) as marked from p)
        select record_id, array_to_string(list_transform(marked, lambda y: replace(replace(replace(regexp_replace(y, '({_DIGITS})' || chr(2) || chr(1) || chr(2), '\1' || chr(2), 'g'), chr(1) || chr(2), '[number]'), chr(1), ''), chr(2), '')), ' ') as pseudo_content,
        len(dates)::int as n_dates, len(s)::int as n_sentences, 'fr' as lang from m""",
    "gazetteer_ner": f"select * from {_FOUND}",
    "ne_by_sentence": f"select record_id, field_name, sent_idx, string_agg(word || '/' || entity_group, ';' order by ent_idx, start_char, word, entity_group) as entities, count(*) as n from {_ENTITIES} group by all",
    "pool_exclusion": f"""select lang as pool_lang, given_name as name, min((record_id, sent_idx))[1] as record_id, min((record_id, sent_idx))[2]::int as sent_idx from (select distinct lang, given_name from pseudo_pool)
        join (select *, string_split(word, ' ')[1] as token from {_ENTITIES} where entity_group = 'PER') on given_name in (token, lower(token), upper(token[1]) || lower(token[2:])) group by 1, 2""",
    "highlight_html": f"""select record_id, replace(replace(content[1:strpos(content, word) - 1], '<', '&lt;'), '>', '&gt;') || '<span style="background-color:lightblue">' || word || '</span>' ||
        replace(replace(content[strpos(content, word) + length(word):], '<', '&lt;'), '>', '&gt;') as html from email_records join (select record_id, arg_min(word, (sent_idx, ent_idx, start_char, word)) as word from {_ENTITIES} where entity_group = 'PER' group by 1) using (record_id) where contains(content, word)""",
    "correction_apply": f"""select record_id, field_name, sent_idx, ent_idx, case when x.g = 'PER' and contains(x.w, ' ') then (start_char + strpos(x.w, ' '))::int else start_char end as start_char, case when x.g = 'MISC' then 'PER' else x.g end as entity_group,
        case when x.g = 'PER' then regexp_replace(x.w, '^[^ ]* ', '') else x.w end as word, case when x.g = 'PER' and contains(x.w, ' ') then (start_char + length(x.w))::int else x.e end as end_char from (
        select record_id, field_name, sent_idx, ent_idx, start_char, min({{'w': word, 'g': entity_group, 'e': end_char, 's': coalesce(score, -1.0)}}) as x from {_ENTITIES} group by all) where x.s >= 0""",
    "mask_metrics": _scores(rf"select least(a, b) as tp, greatest(a - b, 0) as fp, greatest(b - a, 0) as fn from (select len(string_split({_emails('message')}, '[email]')) - 1 as a, len(string_split(regexp_replace(message, '[^ \n\r<>()]*@[^ \n\r<>()]*', '[email]', 'g'), '[email]')) - 1 as b from sample_data where message is not null)"),
    "entity_metrics": _scores(rf"""select len(list_intersect(f, g)) as tp, len(list_filter(f, lambda x: not list_contains(g, x))) as fp, len(list_filter(g, lambda x: not list_contains(f, x))) as fn from (
        select record_id, coalesce(f, []) as f, coalesce(g, []) as g from email_records left join (select record_id, list(distinct token) as f from {_FOUND} where entity_group = 'PER' group by 1) using (record_id)
        left join (select record_id, list(distinct token) as g from (select record_id, unnest(regexp_split_to_array(word, '[^\pL''’\-]+')) as token from {_ENTITIES} where entity_group = 'PER') where token <> '' group by 1) using (record_id))"""),
    "dedupe_join_union": "select file_name, count(*) as n, any_value(e.attachment) as attachment from (select file_name from sample_data union all select file_name from email_records) join email_records e using (file_name) group by 1",
    "bio_to_spans": r"""with t as (select doc_id, generate_subscripts(x, 1) - 1 as k, unnest(x) as tok from (select doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda y: y <> '') as x from documents where text is not null)),
        c as (select doc_id, k, k - row_number() over (partition by doc_id order by k) as run from t where regexp_matches(tok, '^[A-Z]')) select doc_id, 'CAP' as type, min(k)::int as first, max(k)::int as last from c group by doc_id, run""",
    "token_offsets": """with t as (select record_id, generate_subscripts(x, 1) as j, unnest(x) as tok from (select record_id, string_split(content, ' ') as x from email_records)),
        o as (select record_id, j, tok, coalesce(sum(length(tok) + 1) over (partition by record_id order by j rows between unbounded preceding and 1 preceding), 0) as s from t)
        select record_id, (row_number() over (partition by record_id order by j) - 1)::int as k, tok as token, s::int as start_char, (s + length(tok))::int as end_char from o where tok <> ''""",
    "number_mask_phrases": rf"select doc_id, replace(replace(replace(regexp_replace(text, '({_DATE})|[\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]+', chr(1) || '\1' || chr(2), 'g'), chr(1) || chr(2), '[number]'), chr(1), ''), chr(2), '') as masked from documents where text is not null",
    "detokenized": rf"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '([.,!?;:()])', ' \1 ', 'g'), '{_WS}+', ' ', 'g'), ' '),
        ' ([?.!,;:%])', '\1', 'g'), '([(\[{{]) ', '\1', 'g'), ' ([)\]}}])', '\1', 'g'), '([\pL\pN\pM_]) '' ([\pL\pN\pM_])', '\1''\2', 'g'), '([\pL\pN\pM_]) ’ ([\pL\pN\pM_])', '\1’\2', 'g'), '(["“‘]) (.*?) (["”’])', '\1\2\3', 'g') as joined from documents where text is not null""",
    "csv_round_trip": "select row_id, nullif(message, '') as content, nullif(subject, '') as title, 'unmatched' as none from sample_data",
    "xml_round_trip": "select record_id, 'int' as kind, file_name, attachment, coalesce(array_to_string(attachment_type, ','), '') as kinds from email_records",
    "mail_decode": "select record_id, content, subject, epoch(date)::bigint as sent, coalesce(len(attachment_type), 0)::int as attachment, coalesce(array_to_string(attachment_type, ','), '') as kinds from email_records where not contains(content, '<')",
    "field_completion": "select record_id, subject, cast(null as varchar) as sender, cast(null as varchar) as lang from email_records",
    "pool_fallback": """with p as (select lang, list(given_name order by pool_pos) as names from pseudo_pool group by 1), f as (select min(lang) as lang from pseudo_pool)
        select doc_id, p.lang as pool_lang, len(names)::int as n, array_to_string(names[1:3], ',') as names from (select doc_id, case when lang in (select lang from p) then lang else (select lang from f) end as l from documents) join p on p.lang = l""",
    "entities_by_sentence": f"select record_id, sent_idx, count(*)::int as n, string_agg(word, ';' order by start_char, word, entity_group) as words from {_ENTITIES} group by 1, 2",
    "replaced_entities": rf"""with h as (select record_id, content, generate_subscripts(x, 1) - 1 as k, unnest(x) as hit from (select record_id, content, regexp_extract_all(content, '\b{_EMAIL}\b') as x from email_records where not contains(content, '<')))
        select record_id, coalesce(r.t, content) as replaced from (select record_id, content from email_records where content is not null and not contains(content, '<')) left join (
        select record_id, list_reduce(list_prepend(any_value(content), list(k::varchar || chr(1) || hit order by k)), lambda a, b: regexp_replace(a, '(^|[^\pL\pN_@.+%<-])' || regexp_escape(string_split(b, chr(1))[2]) || '($|[^\pL\pN_])', '\1<' || string_split(b, chr(1))[1] || '>\2')) as t from h group by 1) r using (record_id)""",
    "names_across_fields": f"""with e as (select record_id, word, sent_idx = 0 as a from {_ENTITIES} where entity_group = 'PER'), f as (select distinct record_id, word from e where a)
        select record_id, count(*) filter (where a)::int as n_first, count(*) filter (where not a)::int as n_second, count(f.word) filter (where not a)::int as n_met_before, count(f.word) filter (where not a)::int as n_kept from e left join f using (record_id, word) group by 1""",
    "gold_mask": rf"select record_id, list_reduce(list_prepend(content, list_distinct(x)), lambda a, b: replace(a, b, '[email]')) as masked from (select record_id, content, regexp_extract_all(content, '\b{_EMAIL}\b') as x from email_records)",
    "iob_lines": rf"""with t as (select doc_id, generate_subscripts(x, 1) - 1 as k, unnest(x) as token from (select doc_id, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda y: y <> '') as x from documents where text is not null))
        select doc_id, k::int as k, token, case when regexp_matches(token, '^[A-Z]') then 'B-cap' else 'O' end as tag from t""",
    "entities_in_order": f"select record_id, word, entity_group, score, row_number() over (partition by record_id order by score desc nulls last, sent_idx, start_char, word, entity_group, end_char, ent_idx, field_name)::int as place from {_ENTITIES}",
    "repseudonymized": rf"""select record_id, case when m = '' then content else content[1:strpos(content, m) - 1] || (select given_name from pseudo_pool where lang = 'fr' and pool_pos = 0) || content[strpos(content, m) + length(m):] end as replaced
        from (select record_id, content, regexp_extract(content, '\b{_EMAIL}\b') as m from email_records where not contains(content, '<'))""",
    "pseudonym_assign": f"""with e as (select *, row_number() over (partition by record_id order by sent_idx, ent_idx, start_char, word, entity_group) - 1 as k from {_ENTITIES}),
        n as (select *, sum(case when entity_group = 'PER' then 1 else 0 end) over (partition by record_id order by k rows between unbounded preceding and current row) - case when entity_group = 'PER' then 1 else 0 end as before from e),
        b as (select n.*, case entity_group when 'LOC' then '[location]' when 'ORG' then '[organization]' when 'PER' then coalesce(p.given_name, (select given_name from pseudo_pool where lang = 'fr' and pool_pos = 0)) else '[misc]' end as own
              from n left join pseudo_pool p on p.lang = 'fr' and p.pool_pos = n.before),
        f as (select record_id, word, min(k) as k from e group by 1, 2)
        select m.record_id, m.k::int as idx, m.word, case when m.entity_group <> 'PER' then m.own else coalesce(nullif(first.own, ''), m.own) end as pseudonym
        from b m join f on f.record_id = m.record_id and f.word = m.word join b first on first.record_id = f.record_id and first.k = f.k""",
}
