"""Ad-hoc read-only SQL over the named tables (Q1–Q3).

The statement is planned by Spark itself; the guard only decides whether it
may run.  Caps go into the plan as ``LIMIT`` — the full result is never pulled
to the driver to be cut there.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stockroom.functions import exprs
from stockroom.session import scratch_path

# Statement words that make a query not read-only.
FORBIDDEN = ("DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE", "TRUNCATE", "EXEC", "MERGE")

# one left-to-right scan: whichever starts first — a quoted literal/identifier
# or a comment — is consumed whole, so '--' inside a string is not a comment
_QUOTED_OR_COMMENT = re.compile(
    r"(?P<q>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|(?P<c>--[^\n]*|/\*.*?\*/)", re.S)
_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")

# Nodes an analysed statement may consist of outside the given tables.  Anything else —
# files, other tables and views, scripts, commands — is refused.
_NODES = frozenset("""
    Project Filter Aggregate Join LateralJoin Sort Window Generate Expand Sample Union Intersect Except Distinct
    Deduplicate GlobalLimit LocalLimit Offset Tail SubqueryAlias WithCTE CTERelationDef CTERelationRef OneRowRelation
    LocalRelation Range ResolvedHint Repartition RepartitionByExpression RebalancePartitions Pivot Unpivot UnionLoop
    UnionLoopRef View""".split())
# Expressions: Spark's own, without those that run code of a user or read outside data.
_JAVA = frozenset(("reflect", "java_method", "try_reflect"))
_OWN = "org.apache.spark.sql.catalyst.expressions."
_XML = _OWN + "xml."            # XML may name entities elsewhere
_CALLS_OUT = frozenset("""
    CallMethodViaReflection ScalaUDF PythonUDF PythonUDAF PythonUDTF UnresolvedPolymorphicPythonUDTF
    UserDefinedGenerator ScalaAggregator ScalaUDAF ApplyFunctionExpression""".split())


class ReadOnlyViolation(ValueError):
    pass


def check_read_only(text: str) -> str:
    """Q2: accept one SELECT (or WITH … SELECT) statement; return it stripped.

    Comments and quoted literals/identifiers are blanked first, so a keyword
    inside a string or a column such as ``updated_at`` does not trip the
    check, while ``DROP;`` does.
    """
    body = _QUOTED_OR_COMMENT.sub(lambda m: " '' " if m.group("q") else " ", text).strip()
    body = body.rstrip(";").strip()
    if ";" in body:
        raise ReadOnlyViolation("Only one statement is allowed")
    words = [w.upper() for w in _WORD.findall(body)]
    if not words or words[0] not in ("SELECT", "WITH"):
        raise ReadOnlyViolation("Only SELECT queries are allowed")
    bad = sorted(set(words) & set(FORBIDDEN))
    if bad:
        raise ReadOnlyViolation(f"Query contains forbidden keyword: {bad[0]}")
    return text.strip().rstrip(";")


def _each(seq):
    """The elements of a Scala sequence."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def check_parsed(spark: SparkSession, stmt: str) -> None:
    """Q2 before analysis, which already loads the class that a call of Java names: no such
    call, and no name that is computed (``IDENTIFIER``)."""
    def look(e) -> None:
        kind = e.getClass().getSimpleName()
        if "UnresolvedIdentifier" in kind:
            raise ReadOnlyViolation("Computed names are not allowed")
        if kind == "UnresolvedFunction" and list(_each(e.nameParts()))[-1].lower() in _JAVA:
            raise ReadOnlyViolation("Calls of Java are not allowed")
        for child in _each(e.children()):
            look(child)

    def walk(node) -> None:
        if "UnresolvedIdentifier" in node.nodeName():
            raise ReadOnlyViolation("Computed names are not allowed")
        for e in _each(node.expressions()):
            look(e)
        for plan in (*_each(node.children()), *_each(node.innerChildren()), *_each(node.subqueries())):
            walk(plan)
    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(stmt))


def _check_expression(e) -> None:
    name = e.getClass().getName()
    short = name.rsplit(".", 1)[-1].rstrip("$")
    if not name.startswith(_OWN) or name.startswith(_XML) or short in _CALLS_OUT:
        raise ReadOnlyViolation(f"Expression is not allowed: {e.prettyName() if name.startswith(_OWN) else short}")
    for child in _each(e.children()):
        _check_expression(child)


def check_plan(out: DataFrame, tables: dict[str, DataFrame]) -> None:
    """Q2 on the analysed plan: it reads the given tables only, through their views, and
    every other node and expression is on the lists above.  Nothing has run yet."""
    given = {n.lower() for n in tables}

    def walk(node) -> None:
        kind = node.nodeName()
        if kind == "View" and node.isTempView():
            name = node.desc().identifier()
            if name.database().isEmpty() and name.table().lower() in given:
                return                      # a given table; how it is made is the caller's business
            raise ReadOnlyViolation(f"Unknown table: {name.table()}")
        if kind not in _NODES or kind == "View":
            raise ReadOnlyViolation(f"Not a query over the given tables: {kind}")
        for e in _each(node.expressions()):
            _check_expression(e)
        for plan in (*_each(node.children()), *_each(node.subqueries())):
            walk(plan)
    walk(out._jdf.queryExecution().analyzed())


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], text: str,
            args: dict | None = None, limit: int | None = None) -> DataFrame:
    """Q1 + Q3: run a guarded SELECT over ``tables`` (registered as temp views).

    ``args`` are bound as named parameters (``:name``), never spliced into the
    text.  ``limit`` caps the result inside the plan.
    """
    stmt = check_read_only(text)
    check_parsed(spark, stmt)
    # the statement is resolved at once, so the caller's own views come back after it
    before = {n: spark.table(n) for n in tables if spark.catalog.tableExists(n)}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        try:
            out = spark.sql(stmt, args=args) if args else spark.sql(stmt)
        except AnalysisException as e:
            if "NOT_FOUND" in (e.getCondition() or "") and "TABLE" in (e.getCondition() or ""):
                raise ReadOnlyViolation(f"Unknown table: {e.getMessageParameters().get('relationName')}") from None
            raise
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
    check_plan(out, tables)
    return exprs.first(out, limit)


def run_sql_capped(spark: SparkSession, tables: dict[str, DataFrame], text: str, cap: int,
                   args: dict | None = None) -> tuple[DataFrame, int]:
    """Q3: the first ``cap`` rows and the full row count, from one run of the statement.

    Its result is written once to the shared folder, counted on the way (an
    ``Observation``); the head is read from there in the statement's own order.
    """
    full = run_sql(spark, tables, text, args)
    place = "_place"
    while place in full.columns:
        place = "_" + place
    rows, path = Observation(), scratch_path(spark, "statement")
    (full.observe(rows, F.count(F.lit(1)).alias("n")).withColumn(place, F.monotonically_increasing_id())
     .write.mode("overwrite").parquet(path))
    head = spark.read.parquet(path).orderBy(place).limit(cap).drop(place)
    return head, int(rows.get["n"])


def verdicts(spark: SparkSession, tables: dict[str, DataFrame], statements: list[str]) -> DataFrame:
    """(statement, accepted, n_rows): which statements the guard lets through, by their
    place in the list, and how many rows each of those returns."""
    parts = []
    for i, text in enumerate(statements):
        head = (F.lit(i).alias("statement"),)
        try:
            out = run_sql(spark, tables, text)
            parts.append(out.agg(F.count(F.lit(1)).alias("n_rows")).select(*head, F.lit(True).alias("accepted"), "n_rows"))
        except ReadOnlyViolation:
            parts.append(spark.range(1).select(*head, F.lit(False).alias("accepted"), F.lit(None).cast("long").alias("n_rows")))
    return reduce(DataFrame.unionByName, parts)
