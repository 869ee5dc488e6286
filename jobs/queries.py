"""The jobs as registered queries: each runs its job twice into one new folder and returns all that stands there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattisym.operators.reach import shared_folder
from lattisym.plans.corpus import GRAPH_SQL, source_files

from . import code_report, search_index


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word index of all documents, after a second run that finds nothing new."""
    place = _folder(spark, "job1")
    for _ in range(2):
        search_index.run(spark, f"{sf_dir}/documents.parquet", f"{place}/index", f"{place}/checkpoint")
    return search_index.current(spark, f"{place}/index")


def job2_code_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the code base of the tables, after a second run under the same label."""
    place = _folder(spark, "job2")
    for _ in range(2):
        code_report.run(spark, source_files(spark, sf_dir), f"{place}/report", "all")
    return code_report.report(spark, f"{place}/report")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_search_index": job1_search_index, "job2_code_report": job2_code_report}

_UNTESTED = "kind IN ('function', 'method') AND NOT starts_with(file_path, 'tests/')"

ORACLE: dict[str, str] = {
    "job1_search_index": r"SELECT doc_id, lang, token, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents) GROUP BY ALL",
    "job2_code_report": GRAPH_SQL
    + f""", reached AS (SELECT target_qualified AS q FROM tested WHERE kind = 'TESTED_BY'
  UNION SELECT e.target_qualified FROM edges e JOIN tested t ON t.kind = 'TESTED_BY' AND t.target_qualified = e.source_qualified WHERE e.kind = 'CALLS'
  UNION SELECT f.target_qualified FROM edges f JOIN edges e ON f.kind = 'CALLS' AND e.kind = 'CALLS' AND e.target_qualified = f.source_qualified JOIN tested t ON t.kind = 'TESTED_BY' AND t.target_qualified = e.source_qualified),
rows AS (SELECT 'dead' AS section, file_path, qualified_name AS item, line_start AS value FROM named WHERE kind IN ('function', 'method') AND NOT regexp_matches(name, '^(handle_|on_|test_)') AND name <> 'main' AND NOT starts_with(file_path, 'tests/') AND NOT contains(decorators, 'app.route')
  AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'CALLS' AND e.target_qualified = named.qualified_name)
  UNION ALL SELECT 'untested', file_path, qualified_name, line_start FROM named WHERE {_UNTESTED} AND qualified_name NOT IN (SELECT q FROM reached)
  UNION ALL SELECT 'used', n.file_path, n.file_path, count(*) FROM named n JOIN tested e ON e.target_qualified = n.qualified_name GROUP BY n.file_path),
every AS (SELECT section, regexp_extract(file_path, '^.*/') AS directory, item, value FROM rows
  UNION ALL SELECT 'unresolved', regexp_extract(file_path, '^.*/'), target_qualified, count(*) FROM tested WHERE kind = 'CALLS' AND NOT contains(target_qualified, '::') GROUP BY 2, 3)
SELECT 'all' AS label, section, directory, item, CAST(value AS BIGINT) AS value FROM every
UNION ALL SELECT 'all', 'total', '', s, (SELECT CAST(count(*) AS BIGINT) FROM every WHERE section = s) FROM (SELECT unnest(['dead', 'untested', 'used', 'unresolved']) AS s)""",
}
