"""How a query and its SQL come to the same columns: one list of columns drives both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The given tables as fields and observations, in SQL; the same as ``sources.adapters``.
VIEWS = {
    "ln": """SELECT l_orderkey, l_returnflag AS model_name, l_returnflag = 'A' AS is_base, l_linenumber - 1 AS realization, (l_suppkey % 5)::INT AS iy, (l_partkey % 8)::INT AS ix,
        date_trunc('month', l_shipdate)::TIMESTAMP AS time, date_trunc('month', l_shipdate)::TIMESTAMP AS frt, 24.0::DOUBLE * (day(l_shipdate) - 1) AS lead, l_quantity AS value FROM lineitem""",
    "member": "SELECT model_name, is_base, realization, time, iy, ix, avg(value) AS value FROM ln GROUP BY ALL",
    "field": "SELECT model_name, is_base, time, iy, ix, avg(value) AS value FROM ln GROUP BY ALL",
    "cases": "SELECT model_name, is_base, frt, lead, iy, ix, avg(value) AS value FROM ln GROUP BY ALL",
    "wx": "SELECT l_orderkey, l_linenumber, 250 + l_quantity AS t, 500 + 5000 * l_discount AS p, 0.05 + 10 * l_tax AS rh, l_quantity - 25 AS u, l_linenumber - 3.5::DOUBLE AS v FROM lineitem",
    "obs": "SELECT user_id AS station, ts::TIMESTAMP AS time, event_type AS variable, value, event_id FROM events",
    "hourly": "SELECT variable, date_trunc('hour', time) AS time, avg(value) AS value FROM obs GROUP BY ALL",
    "slabs": """SELECT label AS time, (n // 40)::INT AS part, (n % 40)::INT AS iy, (i - 1)::INT AS ix, embedding[i]::DOUBLE AS value FROM (
        SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings), range(1, 65) AS r(i)""",
}
NEEDS = {"member": ("ln",), "field": ("ln",), "cases": ("ln",), "hourly": ("obs",)}
TIME = ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S")


@dataclass(frozen=True)
class Query:
    """``run`` gives the rows, ``columns`` their names with a kind each: s text, t time, r real, p precise real, i int, l long, b boolean."""

    name: str
    columns: str
    run: Callable[[SparkSession, str], DataFrame]
    views: str = ""
    sql: str = ""

    def kinds(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        as_kind = {
            "s": lambda c: c.cast("string"),
            "t": lambda c: F.date_format(c, TIME[0]),
            "r": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0),
            "p": lambda c: F.round(c.cast("double"), 9) + F.lit(0.0),
            "i": lambda c: c.cast("int"),
            "l": lambda c: c.cast("long"),
            "b": lambda c: c.cast("boolean"),
        }
        return self.run(spark, sf_dir).select(*(as_kind[k](F.col(c)).alias(c) for c, k in self.kinds()))

    def oracle(self) -> str:
        as_kind = {"s": "{0}::VARCHAR", "t": "strftime({0}, '" + TIME[1] + "')", "r": "round({0}::DOUBLE, 6) + 0.0", "p": "round({0}::DOUBLE, 9) + 0.0", "i": "{0}::INT", "l": "{0}::BIGINT", "b": "{0}::BOOLEAN"}
        wanted = [v for own in self.views.split() for v in (*NEEDS.get(own, ()), own)]
        views = [f"{v} AS ({VIEWS[v]})" for v in dict.fromkeys(wanted)]
        shown = ", ".join(as_kind[k].format(c) + f" AS {c}" for c, k in self.kinds())
        body = self.sql.strip()
        if body.startswith("WITH "):
            head, body = body[5:].split("\nFINAL\n")
            views.append(head.strip())
        with_ = f"WITH {', '.join(views)} " if views else ""
        return f"{with_}SELECT {shown} FROM ({body}) AS result"
