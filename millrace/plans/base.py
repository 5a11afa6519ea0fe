"""What the modules of registered queries share: the list of entries, tables derived from the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import tables as S

PRICES = [(f"model-{i}", 0.001 * i, 0.002 * i) for i in range(1, 6)]

Run = Callable[[Callable[[str], DataFrame]], DataFrame]
#: name -> (query over a reader of tables, SQL twin or None)
ENTRIES: dict[str, tuple[Run, str | None]] = {}

EVENTS = "(SELECT event_id, user_id AS chunk_id, CASE event_type WHEN 'view' THEN 'RETRIEVED' WHEN 'click' THEN 'CITED' WHEN 'purchase' THEN 'FEEDBACK_USEFUL' WHEN 'error' THEN 'FEEDBACK_USELESS' ELSE 'OTHER' END AS event_type, ts AS created_at FROM events)"
CHUNKS = "(SELECT doc_id, i - 1 AS idx, s[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) d, generate_series(1, len(s)) g(i) WHERE s[i] <> '')"
DATES = "(SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) END AS effective_date FROM documents)"
CALLS = "(SELECT CASE WHEN l_linestatus = 'O' THEN 'CHAT' ELSE 'RERANK' END AS purpose, CASE WHEN l_returnflag = 'A' THEN 'FAILED' ELSE 'OK' END AS status, 'model-' || l_linenumber AS model, CAST(l_quantity * 10 AS BIGINT) AS tokens_in, CAST(l_quantity AS BIGINT) AS tokens_out, l_extendedprice AS latency_ms, l_orderkey, l_linenumber, l_shipdate AS created_at FROM lineitem)"
PRICE_ROWS = "(VALUES " + ", ".join(f"('{m}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for m, a, b in PRICES) + ") p(model, price_in, price_out)"
COSTED = f"(SELECT c.*, tokens_in / 1000 * price_in + tokens_out / 1000 * price_out AS cost FROM {CALLS} c LEFT JOIN {PRICE_ROWS} ON c.model = p.model)"
WORDS = "list_concat(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'), [])"


def add(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def put(f: Run) -> Run:
        ENTRIES[name] = (f, sql)
        return f

    return put


def simple(name: str, run: Run, sql: str | None = None) -> None:
    ENTRIES[name] = (run, sql)


def prices(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("nation").sparkSession.createDataFrame(PRICES, "model string, price_in double, price_out double")


def costed(t: Callable[[str], DataFrame]) -> DataFrame:
    return metrics.estimate_cost(S.engine_calls(t("lineitem")), prices(t))


def events(t: Callable[[str], DataFrame]) -> DataFrame:
    return S.engine_events(t("events"))


def asked(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")
