"""Plans of the JSON language as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyFragmented, NotExecutable
from ..functions import order_key
from ..operators import block_join, broadcast_side, coalesce_exchange, hash_exchange, round_robin_exchange
from .ir import Node

HOWS = {"inner", "left", "right", "full", "left_semi", "left_anti"}
FUNCTIONS: dict[str, Callable[[str | None], Column]] = {
    "count_star": lambda _: F.count(F.lit(1)),
    "count": F.count,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
}


class Compiler:
    """Turns nodes into DataFrames; tables are looked up in `tables`, else in the session's catalog."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, partitions: int = 4, honor_exchanges: bool = False):
        self.spark, self.tables, self.partitions, self.honor = spark, tables or {}, partitions, honor_exchanges

    def __call__(self, node: Node) -> DataFrame:
        return getattr(self, f"_{node.kind.lower()}")(node)

    def _scan(self, node: Node) -> DataFrame:
        name = node.fields["table"]
        return self.tables[name] if name in self.tables else self.spark.table(name)

    def _filter(self, node: Node) -> DataFrame:
        df = self(node.inputs[0])
        return self._checked(node, lambda: df.where(node.fields["predicate"]))

    def _project(self, node: Node) -> DataFrame:
        df = self(node.inputs[0])
        return self._checked(node, lambda: df.selectExpr(*node.fields["columns"]))

    def _join(self, node: Node) -> DataFrame:
        how = node.fields.get("how", "inner")
        if how not in HOWS:
            raise NotExecutable(f"Join: unknown how {how!r}")
        names = [self._alias(n, k) for n, k in zip(node.inputs, "lr", strict=True)]
        if names[0] == names[1]:
            names = ["l", "r"]
        left, right = (self(n).alias(name) for n, name in zip(node.inputs, names, strict=True))
        return self._checked(node, lambda: block_join(left, right, names, node.fields["on"], how))

    def _alias(self, node: Node, default: str) -> str:
        """The name that the join condition uses for a side: its only table's first letter, as in o.cust_id = c.id; l and r where that doesn't tell the sides apart."""
        tables = [n.fields["table"] for n in node.walk() if n.kind == "Scan"]
        return tables[0][0].lower() if len(tables) == 1 else default

    def _sort(self, node: Node) -> DataFrame:
        df, keys = self(node.inputs[0]), []
        for k in node.fields["keys"]:
            k = {"col": k} if isinstance(k, str) else k
            if k["col"] not in df.columns:
                raise NotExecutable(f"Sort: nothing produces {k['col']}")
            keys.append(order_key(k["col"], k.get("desc", False), k.get("nulls")))
        return df.orderBy(*keys)

    def _aggregate(self, node: Node) -> DataFrame:
        """Final over Partial (with or without an exchange between) is one groupBy, which Catalyst splits again."""
        partial = node.inputs[0]
        while partial.kind == "Exchange":
            partial = partial.inputs[0]
        if node.fields["mode"] != "Final" or partial.kind != "Aggregate" or partial.fields["mode"] != "Partial" or partial.fields["group_by"] != node.fields["group_by"]:
            raise NotExecutable("Aggregate: only Final over Partial with the same keys can be run")
        aggs = node.fields.get("aggs") or partial.fields.get("aggs")
        if not aggs:
            raise NotExecutable("Aggregate: no aggs")
        if unknown := [a["fn"] for a in aggs if a.get("fn") not in FUNCTIONS]:
            raise NotExecutable(f"Aggregate: unknown function {unknown[0]}")
        df = self(partial.inputs[0])
        return self._checked(node, lambda: df.groupBy(*node.fields["group_by"]).agg(*(FUNCTIONS[a["fn"]](F.expr(a["arg"]) if a.get("arg") else None).alias(a["as"]) for a in aggs)))

    def _exchange(self, node: Node) -> DataFrame:
        """Broadcasts are always passed on, of a checked size; the others only where asked for, since Spark adds its own."""
        kind, keys = node.exchange()
        df = self(node.inputs[0])
        if kind == "Broadcast":
            return broadcast_side(df)
        if not self.honor:
            return df
        if kind == "Hash":
            return hash_exchange(df, self.partitions, *keys)
        return round_robin_exchange(df, self.partitions) if kind == "RoundRobin" else coalesce_exchange(df)

    def _remoteread(self, node: Node) -> DataFrame:
        raise AlreadyFragmented(f"{node.kind} can't be run")

    _shufflewrite = _remoteread

    def _checked(self, node: Node, make: Callable[[], DataFrame]) -> DataFrame:
        from pyspark.errors import AnalysisException, ParseException

        try:
            return make()
        except (AnalysisException, ParseException) as wrong:
            raise NotExecutable(f"{node.kind}: {str(wrong).splitlines()[0]}") from wrong


def compile_plan(spark: SparkSession, plan: Node, tables: dict[str, DataFrame] | None = None, partitions: int = 4, honor_exchanges: bool = False) -> DataFrame:
    """The plan as a DataFrame. What it leaves open (functions, columns, quoting) is a NotExecutable error, never guessed."""
    return Compiler(spark, tables, partitions, honor_exchanges)(plan)
