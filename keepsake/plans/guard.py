"""Guarded ad-hoc queries: Spark's own parser says what a statement is, and its result and its time are bounded."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without and with a limit of the statement's own, bytes of a payload, and seconds.
DEFAULT_ROWS, MOST_ROWS, MOST_BYTES, SECONDS = 25, 200, 10 * 1024, 20
#: Plans of which a statement may consist; whatever else the parser makes, of this or a later version, is refused.
_READS = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Union", "Distinct", "Deduplicate", "Except", "Intersect", "Generate", "Expand", "Window", "Pivot", "UnresolvedPivot", "Unpivot", "UnpivotTransformer",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "UnresolvedHaving", "WithWindowDefinition", "UnresolvedRelation", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "ResolvedInlineTable", "UnresolvedTableValuedFunction",
}
#: Functions that run code of the JVM, and those that make tables of rows without reading any.
_RUNS_CODE = {"reflect", "java_method", "try_reflect"}
_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}


class Refused(ValueError):
    """The statement is not allowed."""


class TimedOut(RuntimeError):
    """The statement took longer than it may."""


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _plans(node) -> Iterator:
    """A parsed plan's nodes, with those of its common tables and subqueries."""
    yield node
    for child in (*_items(node.children()), *_items(node.innerChildren())):
        if hasattr(child, "expressions"):
            yield from _plans(child)
    for e in _items(node.expressions()):
        for x in _expressions(e):
            if "Subquery" in _kind(x) or _kind(x) in ("Exists", "ListQuery"):
                yield from _plans(x.plan())


def _expressions(e) -> Iterator:
    yield e
    for child in _items(e.children()):
        yield from _expressions(child)


def parsed(spark: SparkSession, sql: str, tables: set[str] | None = None):
    """The statement's plan; raises Refused unless it is a single one that only reads tables, and its own common tables."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise Refused(f"not a single statement: {e.getCondition()}") from None
    nodes = list(_plans(plan))
    known = {t.lower() for t in tables or ()}
    for node in nodes:
        if _kind(node) == "UnresolvedWith":
            known |= {common._1().lower() for common in _items(node.cteRelations())}
    for node in nodes:
        name = _kind(node)
        if name not in _READS:
            raise Refused(f"{name} is more than a query")
        if name == "UnresolvedRelation" and tables is not None and node.multipartIdentifier().mkString(".").lower() not in known:
            raise Refused(f"{node.multipartIdentifier().mkString('.')} is not one of the tables")
        if name == "UnresolvedTableValuedFunction" and node.name().mkString(".").lower() not in _TABLE_FUNCTIONS:
            raise Refused("only functions that make rows are allowed as tables")
        for e in _items(node.expressions()):
            for x in _expressions(e):
                if _kind(x) == "UnresolvedFunction" and x.nameParts().mkString(".").lower() in _RUNS_CODE:
                    raise Refused("functions that run other code are not allowed")
    return plan


def _has_limit(plan) -> bool:
    """Whether the statement as a whole has a limit, below its common tables."""
    while _kind(plan) == "UnresolvedWith":
        plan = plan.child()
    return _kind(plan) == "GlobalLimit"


def safe_select(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The first rows of a query on tables, which it names in {braces}: 25 unless it has a limit of its own, 200 at most.

    Nothing but these tables and the statement's own common tables can be read: no paths, no tables of the catalog.
    Other braces stay as they are.
    """
    run = uuid.uuid4().hex
    views = {name: f"guarded_{run}_{name}" for name in tables}
    text = re.sub(r"\{(\w+)\}", lambda m: views.get(m[1], m[0]), sql)
    plan = parsed(spark, text, set(views.values()))
    try:
        for name, view in views.items():
            tables[name].createOrReplaceTempView(view)
        return spark.sql(text).limit(MOST_ROWS if _has_limit(plan) else DEFAULT_ROWS)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def within(spark: SparkSession, seconds: float, act: Callable):
    """act(), whose Spark jobs are cancelled after so many seconds, by a tag of their own: other jobs go on. Raises TimedOut then."""
    tag, over, sc = f"guarded-{uuid.uuid4().hex}", threading.Event(), spark.sparkContext

    def end() -> None:
        over.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, end)
    sc.addJobTag(tag)
    timer.start()
    try:
        return act()
    except Exception as e:
        if over.is_set():
            raise TimedOut(f"the statement took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def payload(df: DataFrame, seconds: float = SECONDS) -> tuple[str, bool]:
    """(JSON array of the first rows, whether it was cut at 10 KiB); no more than that leaves an executor for a row, and no longer than that it takes."""
    few = df.limit(MOST_ROWS).select(F.substring(F.to_json(F.struct("*")), 1, MOST_BYTES))
    rows = [r[0] for r in within(df.sparkSession, seconds, few.collect)]
    data = ("[" + ",".join(rows) + "]").encode()
    return (data.decode(), False) if len(data) <= MOST_BYTES else (data[:MOST_BYTES].decode(errors="ignore"), True)
