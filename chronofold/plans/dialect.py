"""One statement, two engines: the few places where Spark SQL and DuckDB differ.

A plan is a function of a dialect. ``SPARK`` gives the statement the engine runs, ``DUCK`` the one that a
result is checked against.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Dialect:
    """``inputs``: views that stand for relations of the same name."""

    def __init__(self, spark: bool, inputs: dict[str, str] | None = None):
        self.spark, self.inputs = spark, inputs or {}

    def raw(self, text: str) -> str:
        """A string literal whose backslashes stay."""
        return self.of("r", "") + f"'{text}'"

    def text(self, x) -> str:
        return f"CAST({x} AS {self.of('STRING', 'VARCHAR')})"

    def of(self, spark: str, duck: str) -> str:
        return spark if self.spark else duck

    def n(self, a):
        return f"CAST({self.of('size', 'len')}({a}) AS BIGINT)"

    def chars(self, x):
        return f"CAST(length({x}) AS BIGINT)"

    def found(self, x, p):
        """All matches of a pattern, in order."""
        return self.of(f"regexp_extract_all({x}, r'{p}', 0)", f"regexp_extract_all({x}, '{p}')")

    def uniq(self, a):
        return self.of(f"sort_array(array_distinct({a}))", f"list_sort(list_distinct({a}))")

    def tokens(self, x):
        return self.uniq(self.found(f"lower({x})", "[a-z0-9]+"))

    def both(self, a, b):
        return self.of(f"array_intersect({a}, {b})", f"list_intersect({a}, {b})")

    def less(self, a, b):
        return self.of(f"array_except({a}, {b})", f"list_filter({a}, lambda x: NOT list_contains({b}, x))")

    def join(self, a, sep=" "):
        return self.of(f"array_join({a}, '{sep}')", f"array_to_string({a}, '{sep}')")

    def map(self, a, body):
        return self.of(f"transform({a}, x -> {body})", f"list_transform({a}, lambda x: {body})")

    def where(self, a, body):
        return self.of(f"filter({a}, x -> {body})", f"list_filter({a}, lambda x: {body})")

    def sub(self, x, p, r):
        return self.of(f"regexp_replace({x}, r'{p}', '{r}')", f"regexp_replace({x}, '{p}', '{r}', 'g')")

    def has(self, x, p):
        return self.of(f"({x} RLIKE r'{p}')", f"regexp_matches({x}, '{p}')")

    def part(self, x, p, g=1):
        return f"regexp_extract({x}, {self.raw(p)}, {g})"

    def split(self, x, p):
        return self.of(f"split({x}, '{p}')", f"regexp_split_to_array({x}, '{p}')")

    def explode(self, e, a):
        return self.of(f", LATERAL explode({e}) AS t_{a}({a})", f", unnest({e}) AS t_{a}({a})")

    def words_of(self, x, order, line=False):
        """All values in order, joined by a comma or by a new line."""
        by = self.of("'\\n'", "chr(10)") if line else "','"
        return self.of(f"listagg({x}, {by}) WITHIN GROUP (ORDER BY {order})", f"string_agg({x}, {by} ORDER BY {order})")

    def max_by(self, a, b):
        return self.of(f"max_by({a}, {b})", f"arg_max({a}, {b})")

    def pair(self, a, b):
        """Two values as one that is ordered by the first, then the second."""
        return self.of(f"struct({a}, {b})", f"{{'a': {a}, 'b': {b}}}")

    def min_by(self, a, b):
        return self.of(f"min_by({a}, {b})", f"arg_min({a}, {b})")

    def last_known(self, e, over):
        return self.of(f"last_value({e}) IGNORE NULLS OVER ({over})", f"last_value({e} IGNORE NULLS) OVER ({over})")

    def ts(self, text):
        return self.of(f"TIMESTAMP_NTZ '{text}'", f"TIMESTAMP '{text}'")

    def days(self, later, earlier):
        return self.of(f"CAST(datediff({later}, {earlier}) AS BIGINT)", f"CAST(date_diff('day', {earlier}, {later}) AS BIGINT)")

    def add_days(self, x, n):
        return self.of(f"date_add({x}, CAST({n} AS INT))", f"CAST({x} + CAST({n} AS INT) * INTERVAL 1 DAY AS DATE)")

    def add_months(self, x, n):
        return self.of(f"add_months({x}, CAST({n} AS INT))", f"CAST({x} + CAST({n} AS INT) * INTERVAL 1 MONTH AS DATE)")

    def month_end(self, x):
        return self.of(f"last_day({x})", f"last_day({x})")

    def make_date(self, y, m, d):
        return f"make_date(CAST({y} AS INT), CAST({m} AS INT), CAST({d} AS INT))"

    def dot(self, a, b):
        """Dot product in double precision."""
        return self.of(f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)",
                       f"list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))")

    def at(self, a, i):
        """Element by 1-based place, null outside."""
        return self.of(f"try_element_at({a}, {i})", f"list_extract({a}, {i})")

    def contains(self, a, x):
        return self.of(f"array_contains({a}, {x})", f"list_contains({a}, {x})")

    def slice(self, a, i, n):
        return self.of(f"slice({a}, {i}, {n})", f"list_slice({a}, {i}, {i} + {n} - 1)")

    def json(self, x, k):
        return self.of(f"get_json_object({x}, '$.{k}')", f"json_extract_string({x}, '$.{k}')")

    def series(self, a, b):
        return self.of(f"sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT))", f"generate_series(CAST({a} AS BIGINT), CAST({b} AS BIGINT))")

    def any_true(self, a, body):
        return self.of(f"exists({a}, x -> {body})", f"len(list_filter({a}, lambda x: {body})) > 0")


SPARK, DUCK = Dialect(True), Dialect(False)
Plan = Callable[[Dialect], str]
_plans: dict[str, Plan] = {}


def plan(f: Plan) -> Plan:
    """Register a plan under its function's name."""
    _plans[f.__name__] = f
    return f


def plans() -> dict[str, Plan]:
    return dict(_plans)


def run(spark: SparkSession, sf_dir: str | None, statement: Plan, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a plan over the tables in ``sf_dir``, or over DataFrames given under a table's or relation's name.

    Only tables that the plan names are opened. They are named inside the statement, so no view of the session
    is touched; the views of ``inputs`` have names of their own and go once the plan is resolved.
    """
    views = {name: f"chronofold_{uuid.uuid4().hex}" for name in inputs or {}}
    for name, view in views.items():
        inputs[name].createOrReplaceTempView(view)
    try:
        sql = statement(Dialect(True, {n: v for n, v in views.items() if n not in TABLES}))
        opened = [f"{t} AS (SELECT * FROM {views[t]})" if t in views else f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
        if opened:
            head = re.match(r"\s*WITH (RECURSIVE )?", sql)
            sql = f"WITH {head[1] or ''}{', '.join(opened)}, {sql[head.end():]}" if head else f"WITH {', '.join(opened)} {sql}"
        return spark.sql(sql)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
