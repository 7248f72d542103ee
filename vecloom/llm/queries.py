"""Queries of the llm problems over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.containers import fill_containers, fill_report, split_documents
from vecloom.llm.frequency import check_types, token_terms
from vecloom.llm.mixing import Mix
from vecloom.llm.mojibake import Repair
from vecloom.llm.proportions import ProportionalSample

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _sample(spark: SparkSession, sf: str) -> ProportionalSample:
    return ProportionalSample(_read(spark, sf, "sentence_tokens"), _read(spark, sf, "sample_targets"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf).report().where("short").select("target_id", "category")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf).report()


def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf).rows


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return token_terms(_read(spark, sf, "sentence_tokens"), longest=1).where("mark is not null").select("term", "mark")


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    return token_terms(_read(spark, sf, "sentence_tokens"), longest=1).drop("n_terms")


def p5_types(spark: SparkSession, sf: str) -> DataFrame:
    return check_types(_read(spark, sf, "sentence_tokens"), _read(spark, sf, "pos_summary"))


def p5_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return token_terms(_read(spark, sf, "sentence_tokens"), longest=3)


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    return fill_containers(_read(spark, sf, "documents"), _read(spark, sf, "container_specs"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_documents(_filled(spark, sf))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf)


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing is lost, nothing twice, nothing over capacity: per spec documents, tokens, pieces and containers that hold too much."""
    filled = _filled(spark, sf)
    by_item = filled.groupBy("spec_id", "item").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    items = by_item.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_tokens"), F.sum("pieces").alias("n_pieces"))
    one = filled.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
    over = one.groupBy("spec_id").agg(F.count(F.when(F.col("used") > F.col("capacity_tokens"), 1)).alias("n_over"))
    return items.join(over, "spec_id")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(_filled(spark, sf))


def _mix(spark: SparkSession, sf: str) -> Mix:
    return Mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report().where("exhausted").select("mix_id", "source")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report()


def p7_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).plan.select("mix_id", "source", "weight", "max_repeats", "size", *[F.round(c, 3).alias(c) for c in ("wanted", "given")])


def p7_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Per mix: uses beyond max_repeats, uses that come twice or leave a gap, and whether the mix has within 1 % the tokens that it was to have."""
    mix = _mix(spark, sf)
    most = mix.plan.select("mix_id", "source", "max_repeats")
    by_doc = mix.rows.groupBy("mix_id", "source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("use_no").alias("last"), F.count_distinct("use_no").alias("different"))
    odd = by_doc.join(most, ["mix_id", "source"]).groupBy("mix_id").agg(
        F.count(F.when(F.col("last") > F.col("max_repeats"), 1)).alias("n_over"), F.count(F.when((F.col("different") != F.col("n")) | (F.col("last") != F.col("n")), 1)).alias("n_odd")
    )
    r = mix.report().groupBy("mix_id").agg((F.abs(F.sum("tokens") - F.sum("given")) <= 0.01 * F.sum("given")).alias("reached"))
    return r.join(odd, "mix_id")


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).rows


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return Repair(_read(spark, sf, "documents")).found()


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    return Repair(_read(spark, sf, "documents")).restored()


def queries() -> dict[str, Query]:
    every = (p2_found, p2_report, p2_sample, p5_found, p5_terms, p5_types, p5_phrases, p6_found, p6_containers, p6_totals, p6_report, p7_found, p7_plan, p7_uses, p7_report, p7_mix, p8_found, p8_restored)
    return {f.__name__: f for f in every}


_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
#: Full case folding for the letters that DuckDB's lower() leaves: ß and its capital, final sigma, dotted I, long s.
_FOLD = "replace(replace(replace(lower(replace(word, 'İ', 'i̇')), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"
_TERMS = f"""
    select {_FOLD} as term, count(distinct (row_id, word_id)) as occurrences, count(distinct row_id) as records
    from sentence_tokens where word is not null and row_id is not null group by 1"""
_MARK = "case when records < 5 then 'rare' when records > 0.18::double * (select count(distinct row_id) from sentence_tokens) then 'common' end"

_CATEGORIES = f"""
        with n as (select count(*) as n from sentence_tokens),
        c as (
            select 'pos' as field_name, upper(trim(pos, {_BLANKS})) as category from sentence_tokens
            union all select 'index', case when "index" = floor("index") and "index" >= 1 then cast(cast(least("index", 10) as bigint) as varchar) end from sentence_tokens
            union all select 'head_dist', case when head_dist = floor(head_dist) then cast(cast(head_dist as bigint) as varchar) end from sentence_tokens
        ), k as (select field_name, category, count(*) as rows_there from c where category is not null and category <> '' group by all)"""

ORACLE = {
    "p2_found": f"""{_CATEGORIES}
        select target_id, t.category from sample_targets t cross join n left join k using (field_name, category)
        where coalesce(rows_there, 0) < greatest(min_rows, target_share * sample_share * n)""",
    # The divisor method row by row: floors first, then the smallest priorities (rank - 0.5) / share.
    "p2_report": f"""{_CATEGORIES},
        t as (select t.*, coalesce(rows_there, 0) as available, n, cast(round_even(max(sample_share) over (partition by target_id) * n, 0) as bigint) as size,
            greatest(min_rows::double, target_share * sample_share * n) as wanted from sample_targets t cross join n left join k using (field_name, category)),
        r as (select target_id, category, size, min_rows, target_share, unnest(generate_series(1, least(available, greatest(size, min_rows)))) as rank from t),
        o as (select *, row_number() over (partition by target_id order by rank > min_rows, (rank - 0.5) / target_share, category) as place from r where target_share > 0 or rank <= min_rows),
        s as (select target_id, category, count(*) as taken from o where place <= size or rank <= min_rows group by all)
        select target_id, field_name, category, target_share, min_rows, wanted, available, coalesce(taken, 0) as taken, coalesce(taken, 0) / nullif(sum(coalesce(taken, 0)) over (partition by target_id), 0) as reached_share,
            coalesce(taken, 0) < wanted and available < wanted as short from t left join s using (target_id, category)""",
    "p5_found": f"select * from (select term, {_MARK} as mark from ({_TERMS})) where mark is not null",
    "p5_terms": f"select term, occurrences, records, {_MARK} as mark from ({_TERMS})",
    "p5_types": f"""
        with c as (select batch_id as batch, upper(trim(pos, {_BLANKS})) as tag, count(distinct {_FOLD}) as counted from sentence_tokens where word is not null group by all),
        s as (select summary_id, batch_id as batch, upper(trim(pos, {_BLANKS})) as tag, n_tokens, n_types from pos_summary)
        select summary_id, n_types, coalesce(counted, 0) as counted, case when n_types is null then 'missing' when n_types < 1 or n_types > n_tokens then 'impossible'
            when n_types < coalesce(counted, 0) then 'too_few' when n_types = coalesce(counted, 0) then 'equal' else 'open' end as verdict from s left join c using (batch, tag)""",
    "p5_phrases": f"""
        with w as (select row_id, word_id, min({_FOLD}) as t0 from sentence_tokens where row_id is not null group by all),
        l as (select row_id, t0, lead(t0, 1) over p as t1, lead(t0, 2) over p as t2 from w window p as (partition by row_id order by word_id nulls last)),
        g as (
            select term, 1 as n_terms, occurrences, records from ({_TERMS})
            union all select t0 || ' ' || t1, 2, count(*), count(distinct row_id) from l where t0 is not null and t1 is not null group by t0, t1
            union all select t0 || ' ' || t1 || ' ' || t2, 3, count(*), count(distinct row_id) from l where t0 is not null and t1 is not null and t2 is not null group by t0, t1, t2)
        select term, cast(n_terms as integer) as n_terms, occurrences, records, {_MARK} as mark from g""",
    "p6_found": "select spec_id, doc_id from documents cross join container_specs where strlen(text) > capacity_tokens",
    "p6_totals": """
        select spec_id, count(*) as n_documents, cast(sum(coalesce(strlen(text), 0)) as bigint) as n_tokens, cast(sum(greatest(1, ceil(coalesce(strlen(text), 0) / capacity_tokens))) as bigint) as n_pieces, 0 as n_over
        from documents cross join container_specs where capacity_tokens > 0 group by 1""",
    # Water-filling in closed form: by what a source can give for its weight, those up to the level are clamped, the others share the rest.
    "p7_plan": """
        with s as (select source, sum(coalesce(strlen(text), 0)) as size from documents where source is not null group by 1),
        m as (select mix_id, source, weight, max_repeats, coalesce(size, 0) as size, weight * total_factor * (select sum(size) from s) as wanted, (max_repeats * coalesce(size, 0))::double as most,
            max(total_factor) over (partition by mix_id) * (select sum(size) from s) as total from mix_targets left join s using (source)),
        o as (select *, most / weight as ratio, (total - coalesce(sum(most) over w, 0)) / (sum(weight) over (partition by mix_id) - coalesce(sum(weight) over w, 0)) as level from m where weight > 0
            window w as (partition by mix_id order by most / weight, source rows between unbounded preceding and 1 preceding)),
        l as (select mix_id, arg_min(level, (ratio, source)) as level from o where ratio > level group by 1)
        select mix_id, source, weight, max_repeats, cast(size as bigint) as size, round(wanted, 3) as wanted, round(case when weight > 0 then least(most, weight * coalesce(level, 'inf'::double)) else 0 end, 3) as given
        from m left join l using (mix_id)""",
    "p7_uses": "select mix_id, true as reached, 0 as n_over, 0 as n_odd from mix_targets group by 1",
    "p7_found": """
        with s as (select source, sum(coalesce(strlen(text), 0)) as size from documents where source is not null group by 1),
        t as (select sum(size) as total from s)
        select mix_id, m.source from mix_targets m cross join t left join s using (source)
        where max_repeats * coalesce(size, 0) < weight * total_factor * total""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
