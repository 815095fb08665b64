"""The registered queries of the package, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import cutoff, defects, mixture, neardup, overlap, proportions, quality, tokens
from dialoom.session import table


def _p1(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(table(s, d, "candidates"), table(s, d, "slice_targets"))


def _p4(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(table(s, d, "scored_records"), table(s, d, "keep_targets"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _p1(proportions.exhausted),
        "p1_report": _p1(proportions.report),
        "p1_sample": _p1(proportions.sample),
        "p2_found": lambda s, d: neardup.found(table(s, d, "preference_pairs")),
        "p2_groups": lambda s, d: neardup.groups(table(s, d, "preference_pairs")),
        "p3_found": lambda s, d: defects.found(table(s, d, "preference_pairs")),
        "p4_found": _p4(lambda r, t: cutoff.kept(r, t).select("record_id")),
        "p4_cutoffs": _p4(cutoff.cutoffs),
        "p4_kept_sizes": _p4(cutoff.kept_sizes),
        "p5_found": lambda s, d: overlap.found(table(s, d, "candidates")),
        "p5_edit_pairs": lambda s, d: overlap.edits_found(table(s, d, "candidates")),
        "p5_report": lambda s, d: overlap.report(table(s, d, "candidates")),
        "p6_ids": lambda s, d: tokens.token_ids(table(s, d, "documents")),
        "p7_mixture": lambda s, d: mixture.mixture(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_shares": lambda s, d: mixture.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_found": lambda s, d: quality.found(table(s, d, "documents")),
        "p8_statistics": lambda s, d: quality.judged(table(s, d, "documents")),
    }


_KEY = r"lower(regexp_replace({0}, '^[\s\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g'))"

_P1_REPORT = f"""
with pool as (select distinct prompt_id from candidates where priority_score is not null and prompt_id is not null),
size as (select count(*) as pool, count(*) // 5 as sample_size from pool),
tags as (select distinct c.prompt_id, c.source_dataset, {_KEY.format("t.tag")} as tag
         from candidates c join pool using (prompt_id), unnest(c.slice_tags) as t(tag)),
have as (select tag, source_dataset, count(distinct prompt_id) as available from tags group by all),
cells as (select t.slice_tag, t.source_dataset, t.target_per_mille, t.min_rows, s.pool, s.sample_size, coalesce(h.available, 0) as available,
                 greatest(t.min_rows, s.sample_size * t.target_per_mille // 1000) as required
          from slice_targets t cross join size s left join have h on h.tag = {_KEY.format("t.slice_tag")} and h.source_dataset = t.source_dataset)
"""

_P4 = f"""
with t as (select {_KEY.format("curation_source")} as src, max(keep_per_mille) as pm from keep_targets group by 1),
r as (select record_id, {_KEY.format("curation_source")} as src, quality_score as score, {_KEY.format("quality_bucket")} as bucket
      from scored_records where quality_score between 0 and 1),
n as (select *, count(*) over (partition by src) as n, row_number() over (partition by src order by score desc, record_id) as pos from r join t using (src)),
c as (select src, any_value(n) as n_counted, (any_value(n) * any_value(pm) + 999) // 1000 as n_target,
             min(score) filter (pos <= (n * pm + 999) // 1000) as cutoff from n group by src),
kept as (select n.* from n join c using (src) where n.score >= c.cutoff)
"""


def _shingle_sets(rows: str, text: str) -> str:
    """SQL: the sets s(id, sh) of ``rows`` and their sizes n(id, n)."""
    return f"""
with tok as (select id, regexp_extract_all(lower({text}), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]') as t from ({rows})),
s as (select distinct id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) as sh from tok),
n as (select id, count(*) as n from s group by id),
"""


_P2 = _shingle_sets("select pair_id as id, coalesce(question, '') || chr(10) || coalesce(response_chosen, '') as x from preference_pairs", "x") + """
c as (select a.id as a, b.id as b, count(*) as c from s a join s b on a.sh = b.sh and a.id < b.id group by all)
select a as pair_id_a, b as pair_id_b from c join n x on x.id = a join n y on y.id = b where c >= 0.6 * (x.n + y.n - c)
"""

_P5 = _shingle_sets("select cand_id as id, question as x from candidates where source_split is not null", "x") + f"""
sp as (select cand_id as id, {_KEY.format("source_split")} as split, source_dataset, case when regexp_full_match(lower(source_hash), '[0-9a-f]{{40}}') then lower(source_hash) end as h
       from candidates where source_split is not null),
c as (select a.id as e, b.id as t, count(*) as c from s a join sp x on x.id = a.id and x.split <> 'train' join s b on a.sh = b.sh join sp y on y.id = b.id and y.split = 'train' group by all),
sim as (select e, t, c = x.n and c = y.n as same from c join n x on x.id = e join n y on y.id = t where c >= 0.6 * (x.n + y.n - c)),
hs as (select a.id as e, b.id as t from sp a join sp b on a.h = b.h and a.split <> 'train' and b.split = 'train')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2,
        "p5_found": _P5 + "select distinct least(e, t) as cand_id_a, greatest(e, t) as cand_id_b from (select e, t from sim union all select e, t from hs)",
        "p5_report": _P5 + """select split, source_dataset, count(*) as n_rows, count(*) filter (id in (select e from hs)) as n_same_hash,
count(*) filter (id in (select e from sim where same)) as n_same_text, count(*) filter (id in (select e from sim)) as n_similar_text,
count(*) filter (id in (select e from sim) or id in (select e from hs)) as n_overlapping from sp where split <> 'train' group by all""",
        "p1_found": _P1_REPORT + "select slice_tag, source_dataset from cells where available < required",
        "p1_report": _P1_REPORT + "select *, least(required, available) as quota, greatest(0, required - available) as missing from cells",
        "p4_found": _P4 + "select record_id from kept",
        "p4_cutoffs": _P4 + "select src as curation_source, n_counted, n_target, cutoff, (select count(*) from kept k where k.src = c.src) as n_kept from c",
        "p4_kept_sizes": _P4 + "select src as curation_source, bucket as quality_bucket, count(*) as n_kept, any_value(cutoff) as cutoff from kept join c using (src) group by 1, 2",
    }
