"""Queries of the general problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import hotkeys, packed, rejects


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _failing(spark: SparkSession, sf: str) -> DataFrame:
    names = ("en_ewt_ud_train_sentences", "sentence_lines")
    return rejects.failing_rows(*[_read(spark, sf, t) for t in (*names, "relation_labels")], names)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _failing(spark, sf)


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _failing(spark, sf).groupBy("src_name", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def p1_readable(spark: SparkSession, sf: str) -> DataFrame:
    """The readable sentences of both inputs, cells as delivered."""
    known = rejects.label_set(_read(spark, sf, "relation_labels"), "relation_type")
    a = rejects.separate(rejects.classify_sentences(_read(spark, sf, "en_ewt_ud_train_sentences"), known)).valid
    b = rejects.separate(rejects.classify_lines(_read(spark, sf, "sentence_lines"), known)).valid
    cells = [f"`{c}`" for c in rejects.LINE_FIELDS]
    a = a.select(F.lit("en_ewt_ud_train_sentences").alias("src_name"), "row_id", *cells)
    return a.unionByName(b.select(F.lit("sentence_lines").alias("src_name"), F.col("line_id").alias("row_id"), *cells))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return hotkeys.heavy_keys(hotkeys.token_profile(_read(spark, sf, "sentence_tokens")), 0.085)


def p3_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = hotkeys.token_profile(_read(spark, sf, "sentence_tokens"))
    q = F.col("quantiles")
    return p.select(
        "field_name", "key_text", "measure", "n_rows", "n_values", "min_value", "max_value",
        q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"),
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.packed_fields(*[_read(spark, sf, t) for t in ("en_ewt_ud_train_sentences", "head_dist_summary", "relation_labels")])


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_readable, p3_found, p3_profile, p4_found)}

_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_KEYS = f"""
    select 'pos' as field_name, upper(trim(pos, {_BLANKS})) as key_text, "index", length, head_dist, arity from sentence_tokens
    union all select 'relation_type', relation_type, "index", length, head_dist, arity from sentence_tokens"""

# The reading rules in RE2: a list literal, any other notation, a line.
_LIT = r"""'(?:[^'\\]|\\[\s\S])*'|"(?:[^"\\]|\\[\s\S])*\""""
_ITEM = rf"""(?:{_LIT}|[^\s,'"\[\]]+)"""
_LIST = rf"""^\s*\[\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*(?:,\s*)?)?\]\s*$"""
_VALUE = r"""(?:'(?:[^']|'')*'|"(?:[^"]|"")*"|[^,;|/\s'"\[\]{}()]+)"""
_MANY = rf"""[,;|/\s]*(?:{_VALUE}(?:[,;|/\s]+{_VALUE})*[,;|/\s]*)?"""
_OTHER = rf"""^(?:{_MANY}|\s*\[{_MANY}\]\s*|\s*\{{{_MANY}\}}\s*|\s*\({_MANY}\)\s*)$"""
_FIELD = r"""(?:"(?:[^"]|"")*"|[^",]*)"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cell(c: str) -> str:
    slots = f"regexp_replace(regexp_replace(regexp_replace({c}, {_q(_VALUE)}, 'x', 'g'), {_q(r'[\[\](){}]')}, ' ', 'g'), {_q(r'^\s+|\s+$')}, '', 'g')"
    slots = f"regexp_replace(regexp_replace(regexp_replace({slots}, {_q(r'\s*([,;|/])\s*')}, '\\1', 'g'), {_q(r'\s+')}, ' ', 'g'), '[,;|/]$', '')"
    return f"""case when {c} is null or not regexp_matches({c}, '\\S') then 0
        when regexp_matches({c}, {_q(_LIST)}) then len(regexp_extract_all({c}, {_q(_ITEM)}))
        when {slots} = '' then 0 else len(regexp_replace({slots}, '[^,;|/ ]', '', 'g')) + 1 end"""


def _bad(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '\\S') and not regexp_matches({c}, {_q(_LIST)}) and not regexp_matches({c}, {_q(_OTHER)}), false)"


def _items(c: str) -> str:
    return f"case when regexp_matches({c}, {_q(_LIST)}) then regexp_extract_all({c}, {_q(_ITEM)}) else regexp_extract_all({c}, {_q(_VALUE)}) end"


P1_SQL = f"""
    with fields as (
        select line_id, regexp_matches(raw_line, {_q("^" + _FIELD + "(?:," + _FIELD + ")*$")}) as closed,
            regexp_extract_all(raw_line || ',', {_q(_FIELD + ",")}) as f
        from sentence_lines
    ), lines as (
        select line_id, case when not closed then 'quoting' when closed is null or len(f) <> 7 then 'column_count' end as line_fault,
            list_transform(f, lambda x: case when x like '"%' then replace(x[2:-3], '""', '"') when x = ',' then null else x[:-2] end) as f
        from fields
    ), cells as (
        select 'en_ewt_ud_train_sentences' as src_name, row_id, null as line_fault, tokens, relation_type, ariety from en_ewt_ud_train_sentences
        union all select 'sentence_lines', line_id, line_fault, f[2], f[6], f[7] from lines
    ), counted as (
        select *, {_cell("tokens")} as n, {_cell("relation_type")} as n_relation, {_cell("ariety")} as n_ariety
        from cells cross join (select list(relation_type) as labels from relation_labels)
    ), judged as (
        select src_name, row_id, case when line_fault is not null then line_fault
            when {_bad("tokens")} or {_bad("relation_type")} or {_bad("ariety")} then 'quoting'
            when n > 0 and (regexp_matches(relation_type, '\\S') and n_relation <> n or regexp_matches(ariety, '\\S') and n_ariety <> n) then 'column_count'
            when n = 0
                or len(list_filter({_items("relation_type")}, lambda x: not list_contains(labels, case when x[1] in ('''', '"') then x[2:-2] else x end))) > 0
                or len(list_filter({_items("ariety")}, lambda x: not regexp_full_match(x, '\\+?[0-9]+'))) > 0 then 'bad_value' end as reason
        from counted
    )
    select * from judged where reason is not null"""

P1_READABLE_SQL = f"""
    with failing as ({P1_SQL}), lines as (
        select line_id, list_transform(regexp_extract_all(raw_line || ',', {_q(_FIELD + ",")}), lambda x: case when x like '"%' then replace(x[2:-3], '""', '"') when x = ',' then null else x[:-2] end) as f
        from sentence_lines where line_id not in (select row_id from failing where src_name = 'sentence_lines')
    )
    select 'en_ewt_ud_train_sentences' as src_name, row_id, sentence_id, tokens, pos, "index", head_dist, relation_type, ariety
    from en_ewt_ud_train_sentences where row_id not in (select row_id from failing where src_name = 'en_ewt_ud_train_sentences')
    union all select 'sentence_lines', line_id, f[1], f[2], f[3], f[4], f[5], f[6], f[7] from lines"""

# A value that holds a delimiter, quote or bracket is quoted, so the values of a packed cell are those of the rules above, whatever its notation.
_GAP = r"\s*[,;|/]\s*|\s+"
P4_SQL = f"""
    with failing as ({P1_SQL}), good as (select * from en_ewt_ud_train_sentences where row_id not in (select row_id from failing where src_name = 'en_ewt_ud_train_sentences')), cells as (
        select 'en_ewt_ud_train_sentences' as src_name, row_id, 'tokens' as field_name, tokens as cell from good union all select 'en_ewt_ud_train_sentences', row_id, 'pos', pos from good
        union all select 'en_ewt_ud_train_sentences', row_id, 'head_dist', head_dist from good union all select 'head_dist_summary', summary_id, 'top_pos_vals', top_pos_vals from head_dist_summary
    ), packed as (select * exclude cell, trim(cell, {_BLANKS}) as c from cells where cell is not null and not regexp_matches(cell, {_q(_LIST)})),
    cores as (select * exclude c, case when c like '[%]' or c like '{{%}}' or c like '(%)' then trim(c[2:-2], {_BLANKS}) else c end as core from packed),
    parts as (select * exclude core, regexp_extract_all(core, {_q(_VALUE + "|" + _GAP)}) as parts from cores),
    pieces as (select * exclude parts, unnest(parts) as x, generate_subscripts(parts, 1) as k from parts),
    slots as (select *, regexp_full_match(x, {_q(_GAP)}) as gap from pieces),
    items as (select *, cast(1 + sum(gap::int) over (partition by src_name, row_id, field_name order by k) as bigint) as item_no from slots)
    select src_name, row_id, field_name, item_no, case when x[1] in (chr(39), '"') then replace(x[2:-2], x[1] || x[1], x[1]) else x end as item
    from items where not gap and len(x) > 0 and x <> repeat(chr(39), 2) and x <> '""'"""

ORACLE = {
    "p4_found": P4_SQL,
    "p1_found": P1_SQL,
    "p1_readable": P1_READABLE_SQL,
    "p1_reasons": f"select src_name, reason, count(*) as n_rows from ({P1_SQL}) group by all",
    "p3_found": f"select field_name, key_text from ({_KEYS}) where key_text is not null group by all having count(*) >= 0.085::double * (select count(*) from sentence_tokens)",
    "p3_profile": f"""
        select field_name, key_text, measure, count(*) as n_rows, count(v) as n_values, min(v) as min_value, max(v) as max_value,
            quantile_disc(v, 0.25) as q25, quantile_disc(v, 0.5) as q50, quantile_disc(v, 0.75) as q75
        from (
            select field_name, key_text, 'index' as measure, "index" as v from ({_KEYS}) union all select field_name, key_text, 'length', length from ({_KEYS})
            union all select field_name, key_text, 'head_dist', head_dist from ({_KEYS}) union all select field_name, key_text, 'arity', arity from ({_KEYS})
        ) where key_text is not null group by all""",
}
