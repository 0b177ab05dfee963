"""The queries of the language-model data problems (p6, p8, p9, p10), and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.packing import packed_documents, unused_space
from roadloom.llm.runs import p6_runs
from roadloom.llm.spam import spam, spam_scores
from roadloom.llm.tokens import encoded, token_counts
from roadloom.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text", "lang"))


QUERIES: dict[str, Query] = {
    "p6_found": lambda s, d: p6_runs(table(s, d, "fcd")).select("id_veh", "id_fcd_first", "id_fcd_last"),
    "p6_runs": lambda s, d: p6_runs(table(s, d, "fcd")),
    "p8_ids": lambda s, d: encoded(_documents(s, d)),
    "p8_token_counts": lambda s, d: token_counts(_documents(s, d)),
    "p9_assignments": lambda s, d: packed_documents(_documents(s, d)),
    "p9_unused_space": lambda s, d: unused_space(packed_documents(_documents(s, d))),
    "p10_found": lambda s, d: spam(_documents(s, d)).select("doc_id"),
    "p10_scores": lambda s, d: spam_scores(_documents(s, d)),
}

SQL: dict[str, str] = {
    "p6_found": r"""
WITH c AS (SELECT try_cast(try_cast(trim(id_fcd) AS DECIMAL(38,6)) AS BIGINT) AS id, *, regexp_extract_all(coalesce(regexp_extract(geometry, '[(\[][^(\[]*$'), ''), '-?\d+(?:\.\d+)?') AS g FROM fcd),
f AS (SELECT * FROM c WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at, batch) = 1),
p AS (SELECT id, id_veh, ts, CASE WHEN geometry IS NULL THEN x ELSE CAST(g[1] AS DOUBLE) END AS x, CASE WHEN geometry IS NULL THEN y ELSE CAST(g[2] AS DOUBLE) END AS y FROM f),
l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WHERE ts IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY id_veh ORDER BY ts, id)),
r AS (SELECT *, sum(CASE WHEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY id_veh ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT id_veh, arg_min(id, (ts, id)) AS id_fcd_first, arg_max(id, (ts, id)) AS id_fcd_last FROM r GROUP BY id_veh, run HAVING count(*) >= 3""",
}
