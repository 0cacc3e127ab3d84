"""Queries of this subpackage: name to (session, data directory) -> DataFrame, over whole tables and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bin_packing, format_dedup, mixing, quantile_digest, related_splits, response_defects, split_overlap, tokenizer, visual_form
from millrace.runtime import table


def _with(*names: str) -> Callable:
    """Bind a function of tables to the tables of a data directory."""

    def bound(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))

    return bound


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _with("problems")(related_splits.same_sources),
    "p1_splits": _with("problems")(related_splits.split_records),
    "p1_increments": _with("problems")(lambda problems: related_splits.split_records(problems, increments=3)),
    "p1_members": _with("problems")(related_splits.source_members),
    "p1_two_jobs": _with("problems")(related_splits.split_in_jobs),
    "p2_micro_batches": _with("train_data", "pack_limits")(bin_packing.micro_batches),
    "p2_certificate": _with("train_data", "pack_limits")(bin_packing.certificate),
    "p3_percentiles": _with("trace_events")(quantile_digest.engine_percentiles),
    "p3_digests": _with("trace_events")(quantile_digest.day_digests),
    "p4_found": _with("problems", "raw_records")(format_dedup.copies),
    "p4_records": _with("problems", "raw_records")(format_dedup.deduplicated),
    "p4_collisions": _with("problems", "raw_records")(format_dedup.collided),
    "p5_found": _with("problems")(split_overlap.found),
    "p5_classes": _with("problems")(split_overlap.classes_with_links),
    "p5_report": _with("problems")(split_overlap.report),
    "p7_found": _with("samples", "train_data", "turns", "documents")(response_defects.found),
    "p7_defects": _with("samples", "train_data", "turns", "documents")(response_defects.labelled),
    "p8_ids": _with("documents")(tokenizer.encoded),
    "p8_totals": _with("documents")(tokenizer.token_totals),
    "p9_mixture": _with("documents", "mixture_targets")(mixing.mix),
    "p9_shares": _with("documents", "mixture_targets")(mixing.report),
    "p10_found": _with("documents")(visual_form.lookalikes),
    "p10_forms": _with("documents")(visual_form.classes),
}

# points between digits are marked twice, as neighbouring matches share a digit
_MARKED = r"replace(replace(lower(upper({x})), 'ς', 'σ'), 'ß', 'ss')"
for _ in range(2):
    _MARKED = rf"regexp_replace({_MARKED}, '(\p{{{{Nd}}}})\.(\p{{{{Nd}}}})', '\1' || chr(57344) || '\2', 'g')"
_MARKED = rf"regexp_replace({_MARKED}, '[-−](\p{{{{Nd}}}})', chr(57345) || '\1', 'g')"
_FORM = rf"replace(replace(regexp_replace({_MARKED}, '[\p{{{{P}}}}\s\p{{{{Z}}}}\p{{{{Cf}}}}\x{{{{0b}}}}\x{{{{1c}}}}-\x{{{{1f}}}}\x{{{{85}}}}]+', '', 'g'), chr(57344), '.'), chr(57345), '-')"
_RECORDS = f"""WITH r AS (SELECT 'problems' AS tbl, problem_id AS id, question AS q, answer_value AS a FROM problems UNION ALL
SELECT 'raw_records', raw_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.question') END, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.answer_value') END FROM raw_records),
f AS (SELECT tbl, id, {_FORM.format(x="q")} AS q, {_FORM.format(x="a")} AS a FROM r WHERE id IS NOT NULL AND q IS NOT NULL AND a IS NOT NULL)"""

ORACLE: dict[str, str] = {
    "p4_found": _RECORDS + ", g AS (SELECT tbl, q, a, min(id) AS id_a FROM f GROUP BY 1, 2, 3) SELECT tbl, id_a, id AS id_b FROM f JOIN g USING (tbl, q, a) WHERE id > id_a",
    "p4_records": _RECORDS + " SELECT tbl, min(id) AS id, count(*) AS copies FROM f GROUP BY tbl, q, a",
    "p4_collisions": "SELECT CAST(NULL AS VARCHAR) AS tbl, CAST(NULL AS BIGINT) AS h1, CAST(NULL AS BIGINT) AS h2, CAST(NULL AS BIGINT) AS texts WHERE false",
}
