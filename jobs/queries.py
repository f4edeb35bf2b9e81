"""The jobs as registered queries: run twice into a folder of their own, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.lineage import shared_folder
from causeway.plans.queries import PAIRS
from causeway.plans.registry import query, rounded
from jobs import inspection_panel, report_intake


def _twice(job, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole output as it stands after the second run, without gaps: -1 and '' where a part has no such column."""
    out = f"{shared_folder(spark)}/{job.__name__.rpartition('.')[2]}-{uuid.uuid4().hex}"
    for _ in range(2):
        job.run(spark, sf_dir, out)
    return job.output(spark, out).na.fill(-1).na.fill("")


@query(f"""WITH {PAIRS}, moves AS (
    SELECT year, state4, count(*) AS n, {", ".join(f"(count(*) FILTER (y_next = {k}) + 0.5::DOUBLE) / (count(*) + 2) AS p{k}" for k in range(4))} FROM pairs GROUP BY year, state4)
SELECT 'panel' AS part, CAST(key AS BIGINT) AS key, year, state4, coalesce(age, -1) AS age, CAST(-1 AS BIGINT) AS n, {", ".join(f"-1.0::DOUBLE AS p{k}" for k in range(4))} FROM panel
UNION ALL SELECT 'transitions', -1, year, state4, -1, n, {", ".join(f"round(p{k}, 6)" for k in range(4))} FROM moves""")
def job1_inspection_panel(spark, d):
    return rounded(_twice(inspection_panel, spark, d), "p0", "p1", "p2", "p3")


_NAMES = report_intake.NAMES


@query(f"""WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(nullif(trim(lang), ''), 'und') AS lang FROM documents WHERE doc_id IS NOT NULL),
counted AS (SELECT *, regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?') AS numbers FROM texts),
lowest AS (SELECT *, list_min(list_transform(numbers, lambda x: CAST(right(split_part(x, '.', 1), 1) AS INTEGER))) AS r FROM counted),
reports AS (SELECT doc_id, source, lang, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, len(numbers) AS n_numbers,
                   CASE WHEN r >= 7 THEN 0 WHEN r >= 5 THEN 1 WHEN r >= 3 THEN 2 WHEN r IS NOT NULL THEN 3 END AS state4, sha256(text) AS digest FROM lowest)
SELECT 'report' AS part, doc_id, coalesce(source, '') AS source, lang, n_chars, n_lines, CAST(n_numbers AS BIGINT) AS n_numbers, CAST(coalesce(state4, -1) AS INTEGER) AS state4, digest,
       CAST(-1 AS BIGINT) AS n_reports, CAST(-1 AS BIGINT) AS n_empty, CAST(-1 AS BIGINT) AS n_texts, CAST(-1 AS BIGINT) AS n_rated, {", ".join(f"CAST(-1 AS BIGINT) AS {n}" for n in _NAMES)}, CAST(-1 AS INTEGER) AS passes
FROM reports
UNION ALL
SELECT 'quality', -1, coalesce(source, ''), lang, -1, -1, -1, -1, '', count(*), count(*) FILTER (n_chars = 0), count(DISTINCT digest), count(state4),
       {", ".join(f"count(*) FILTER (state4 = {k})" for k in range(4))}, CAST(count(*) FILTER (n_chars > 0) >= 0.95::DOUBLE * count(*) AS INTEGER)
FROM reports GROUP BY lang, source""")
def job2_report_intake(spark, d):
    out = _twice(report_intake, spark, d)
    return out.withColumn("passes", F.coalesce(F.col("passes").cast("int"), F.lit(-1)))
