"""One read-only SELECT over given tables.

What Spark itself reads is checked, not the text: every node of the parsed statement must be one of a query, every table one of
those given (or a name of a WITH clause that is in scope), every function a built-in one of a harmless group. Comments, quotes and letter
case therefore make no difference, and a column may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sheet import PlanError

MOST_ROWS = 200_000
#: Nodes of queries in Spark's parsed plans.
NODES = set(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Join LateralJoin Union Except Intersect SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedInlineTable OneRowRelation LocalRelation WithWindowDefinition Generate Pivot Unpivot UnresolvedTableValuedFunction UnresolvedTableSpec".split()
)
#: Groups of Spark's built-in functions that only compute from their arguments.
GROUPS = set(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs operator predicate_funcs string_funcs struct_funcs window_funcs".split()
)
#: Built-in functions in no such group that compute from their arguments too.
HARMLESS = {"typeof", "equal_null", "monotonically_increasing_id", "assert_not_null"}
#: Table functions that make rows from their arguments.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}
#: Parts of parsed expressions that stand for names, and are resolved against the given tables.
NAMES = set(
    "UnresolvedGenerator UnresolvedAttribute UnresolvedStar UnresolvedFunction UnresolvedAlias UnresolvedExtractValue UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedSubqueryColumnAliases UnresolvedWindowExpression UnresolvedStarExceptOrReplace".split()
)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.length())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().removesuffix("$")


def _parts(seq) -> list[str]:
    return [str(x) for x in _items(seq)]


class _Gate:
    def __init__(self, spark: SparkSession, tables: set[str]):
        self.spark, self.tables = spark, {t.lower() for t in tables}
        self.registry = spark._jsparkSession.sessionState().functionRegistry()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def plan(self, node, names: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in NODES:
            raise PlanError(f"only SELECT is allowed, not {kind}")
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                own = str(pair._1()).lower()
                self.plan(pair._2(), names | {own} if node.allowRecursion() else names)
                names = names | {own}
        if kind == "UnresolvedRelation":
            parts = _parts(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in self.tables | names:
                raise PlanError(f"there is no table {'.'.join(parts)!r}")
        if kind == "UnresolvedTableValuedFunction" and (parts := _parts(node.name())) and (len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS):
            raise PlanError(f"function {'.'.join(parts)} is not allowed")
        for e in _items(node.expressions()):
            self.expression(e, names)
        for child in _items(node.children()):
            self.plan(child, names)

    def expression(self, node, names: frozenset[str]) -> None:
        kind = _kind(node)
        if "Unresolved" in kind and kind not in NAMES or "Identifier" in kind:
            raise PlanError(f"{kind} is not allowed")
        if kind == "UnresolvedFunction":
            self.function(_parts(node.nameParts()))
        if kind == "UnresolvedGenerator":
            self.function([str(node.name().unquotedString())])
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self.plan(node.plan(), names)
        for child in _items(node.children()):
            self.expression(child, names)

    def function(self, parts: list[str]) -> None:
        name = parts[-1].lower()
        if len(parts) == 1 and name not in HARMLESS:
            known = self.registry.lookupFunction(self.identifier(name))
            if known.isDefined() and known.get().getGroup() in GROUPS:
                return
        if len(parts) != 1 or name not in HARMLESS:
            raise PlanError(f"function {'.'.join(parts)} is not allowed")


#: Forms of another dialect that Spark would read as something else.
MISREAD = {r"(?i)\basof\s+join\b": "ASOF JOIN", r"(?i)\busing\s+sample\b": "USING SAMPLE", r"(?i)\bqualify\b": "QUALIFY"}


def _bare(sql: str) -> str:
    """The text with literals and quoted names emptied, then without comments."""
    token = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/"
    return re.sub(token, lambda m: {"'": "''", '"': "x", "`": "x"}.get(m[0][0], " "), sql, flags=re.S)


def check_sql(spark: SparkSession, sql: str, tables: set[str]) -> str:
    """The statement without a final semicolon, if it is allowed."""
    sql = sql.strip().rstrip("; \n\t")
    for pattern, name in MISREAD.items():
        if re.search(pattern, _bare(sql)):
            raise PlanError(f"{name} is not supported")
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise PlanError(f"this is not one SELECT: {str(error).splitlines()[0]}") from error
    _Gate(spark, tables).plan(tree, frozenset())
    return sql


def flat(df: DataFrame) -> DataFrame:
    """Decimals as doubles, times as dates, nested values as JSON."""
    out = []
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], most: int | None = MOST_ROWS) -> DataFrame:
    """Runs one checked SELECT. A result of more than ``most`` rows is refused (None: any size).

    The names of ``tables`` hold for this statement only: views of the session with these names are as before afterwards.
    """
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.ansi.doubleQuotedIdentifiers", "spark.sql.runSQLOnFiles")}
    before = {}
    try:
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        sql = check_sql(spark, sql, set(tables))
        views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
        before = {name: spark.table(name) if name.lower() in views else None for name in tables}
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        out = flat(spark.sql(sql))
        out.schema  # names are looked up here, while the views are there
    finally:
        for name, df in before.items():
            spark.catalog.dropTempView(name) if df is None else df.createOrReplaceTempView(name)
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if most is not None and out.limit(most + 1).count() > most:
        raise PlanError(f"the result has more than {most} rows: aggregate or filter further")
    return out
