"""SQL searches over a tenant's tables."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import ParseException

from spanlake.functions.names import tenant_from_sql
from spanlake.sources.storage import json_rows, register

#: Commands that only tell; every other command is refused, as is any statement that holds one that writes.
TELLING = ("Explain", "Show", "Describe", "Desc")
LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Functions that run code outside the query.
OUTSIDE = re.compile(r"\b(reflect|java_method|try_reflect)\s*\(", re.IGNORECASE)


@dataclass
class SearchQuery:
    query: str
    limit: int = 0
    offset: int = 0
    client_id: str | None = None
    request_id: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass
class SearchResponse:
    """rows and total_count are those of a page with a limit; without one, results holds the whole result, a JSON document a row, and no rows come to the driver."""

    request_id: str
    columns: list[str]
    rows: list[dict]
    total_count: int | None
    has_more: bool
    results: DataFrame
    seconds: float


def _beneath(node) -> list:
    """The plans that a node is made of: its inputs, what a WITH names, and the sub-queries of its expressions."""
    logical_plan = node.getClass().getClassLoader().loadClass(f"{LOGICAL}LogicalPlan")
    parts = [seq.apply(i) for seq in (node.children(), node.innerChildren(), node.subqueries()) for i in range(seq.size())]
    return [p for p in parts if logical_plan.isInstance(p)]


def check_reading(spark: SparkSession, query: str, only_views: bool = False) -> None:
    """Raises ValueError unless the query is one statement that reads, by its parsed plan; with only_views, also if it names tables by catalog or by path."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except ParseException as e:
        raise ValueError("not one SQL statement") from e
    if OUTSIDE.search(query):
        raise ValueError("only functions that compute are allowed")
    if plan.getClass().getSimpleName().startswith(TELLING):
        return
    loader = plan.getClass().getClassLoader()
    writing = [loader.loadClass(f"{LOGICAL}{name}") for name in ("Command", "ParsedStatement")]
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        if any(c.isInstance(node) for c in writing) or node.getClass().getSimpleName().startswith("Insert"):  # INSERT OVERWRITE DIRECTORY is neither
            raise ValueError("only statements that read are allowed")
        if only_views and node.getClass().getSimpleName() == "UnresolvedRelation" and node.multipartIdentifier().size() > 1:
            raise ValueError("only a tenant's own tables are allowed")
        waiting += _beneath(node)


def sql(spark: SparkSession, query: str, limit: int = 0, offset: int = 0, only_views: bool = False) -> DataFrame:
    """The result of one reading statement; limit 0 is no limit. Pages need an ORDER BY that leaves no ties."""
    query = query.rstrip().rstrip(";")
    check_reading(spark, query, only_views)
    df = spark.sql(query)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df


def search(spark: SparkSession, root: str, request: SearchQuery) -> SearchResponse:
    """Runs a query over the views traces, metrics and logs of its tenant, in a session of its own, so that searches at the same time don't see each other's views.

    With a limit, the page's rows come to the driver, total_count counts the whole result and has_more tells whether rows follow the page.
    """
    began = time.monotonic()
    session = spark.newSession()
    register(session, root, request.client_id or tenant_from_sql(request.query) or "default")
    whole = sql(session, request.query, offset=request.offset, only_views=True)
    results, rows, total, more = json_rows(whole), [], None, False
    if request.limit:
        found = [json.loads(r["json"]) for r in json_rows(whole.limit(request.limit + 1)).collect()]
        rows, more = found[: request.limit], len(found) > request.limit
        total = sql(session, request.query).count() if more or not rows else request.offset + len(rows)
    return SearchResponse(request.request_id, whole.columns, rows, total, more, results, time.monotonic() - began)
