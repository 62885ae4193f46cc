"""Joins whose keys meet many rows with many: the pairs are dealt out, not only the keys."""

from __future__ import annotations

from math import ceil

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rows of a key that a block holds at most (about), pairs and rows that a task gets (about), and pairs for each row from which on pairs count.
BLOCK_ROWS, TASK_PAIRS, TASK_ROWS, MANY = 2048, 8_000_000, 500_000, 4
#: Hot keys up to which their list is sent to every task.
BROADCAST_KEYS = 100_000


def equi_keys(joined: DataFrame) -> tuple[list[str], list[str], str | None]:
    """The equal expressions of a join's two sides as Catalyst finds them, and what else it asks; no expressions for other plans."""
    found = joined.sparkSession._jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys.unapply(joined._jdf.queryExecution().analyzed())
    if found.isEmpty():
        return [], [], None
    _, left, right, other = (getattr(found.get(), f"_{i}")() for i in range(1, 5))
    text = lambda keys: [keys.apply(i).sql() for i in range(keys.size())]
    return text(left), text(right), other.get().sql() if other.isDefined() else None


def block_join(left: DataFrame, right: DataFrame, names: list[str], on: str, how: str) -> DataFrame:
    """left.join(right, on, how), whole, for sides aliased as `names`. Where keys make many more pairs than there are rows, a key's rows are cut
    into blocks on both sides and each pair of blocks is a cell of its own, so that a task's pairs don't grow with the tables; rows without a partner are added after.

    One job counts rows by key first. A row travels once for each block of the other side: pairs / BLOCK_ROWS rows for either side, and the rows themselves.
    Joins without equal keys, and those that give each row once at most, stay as they are.
    """
    plain = left.join(right, F.expr(on), how)
    if how not in ("inner", "left", "right", "full"):
        return plain
    own, other, rest = equi_keys(plain)
    if not own:
        return plain
    new = "_" * (1 + max(map(len, [*left.columns, *right.columns])))  # longer than any column's name
    lk, rk, hk = ([f"{new}{side}{i}" for i in range(len(own))] for side in "lrh")
    left, right = left.withColumns(dict(zip(lk, map(F.expr, own)))), right.withColumns(dict(zip(rk, map(F.expr, other))))
    if fractions := [i for i, k in enumerate(lk) if left.schema[k].dataType.typeName() in ("float", "double")]:  # as text, since Spark would deal them out anew to make 0 and -0 equal
        left, right = (s.withColumns({k[i]: (F.col(k[i]) + 0).cast("string") for i in fractions}) for s, k in ((left, lk), (right, rk)))
    same = lambda a, b: [F.col(x) == F.col(y) for x, y in zip(a, b)]
    sizes = left.groupBy(*lk).agg(F.count("*").alias("n")).join(right.groupBy(*rk).agg(F.count("*").alias("m")), same(lk, rk), "full").select(*(F.col(x).alias(y) for x, y in zip(lk, hk)), "n", "m")
    hot = sizes.select(*hk, F.ceil(F.col("n") / BLOCK_ROWS).alias(f"{new}a"), F.ceil(F.col("m") / BLOCK_ROWS).alias(f"{new}b")).where(F.greatest(f"{new}a", f"{new}b") > 1).dropna()
    try:
        pairs, rows, keys = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m")), F.sum(F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))), F.count_if(F.greatest("n", "m") > BLOCK_ROWS)).first()
    except PySparkException:  # what fails here fails when the query runs, and is told there
        return plain
    if (pairs or 0) <= max(TASK_PAIRS, MANY * (rows or 0)):
        return plain
    tasks, copying = max(ceil(pairs / TASK_PAIRS), ceil(rows / TASK_ROWS)), ceil(pairs / BLOCK_ROWS / TASK_ROWS)
    hot = F.broadcast(hot) if keys <= BROADCAST_KEYS else hot
    place = StructType([*(StructField(f"k{i}", left.schema[k].dataType) for i, k in enumerate(lk)), StructField("a", LongType()), StructField("b", LongType())])

    def dealt(side: DataFrame, name: str, keys: list[str], cell: str, cut: str, copied: str) -> DataFrame:
        """The side's rows with a cell, once for each block that the other side has of their key, in `tasks` parts. One column holds the cell: parts stay, also where a key is constant and folded away."""
        many = lambda c: F.coalesce(f"{new}{c}", F.lit(1))
        numbered = _numbered(side.dropna(subset=keys), f"{new}n").join(hot, same(keys, hk), "left")
        numbered = numbered.repartition(copying, f"{new}n") if copying > 1 else numbered  # a small file is one task, and its rows' copies may be many
        block, blocks = F.pmod(f"{new}n", many(cut)), F.explode(F.sequence(F.lit(0).cast("long"), many(copied) - 1))
        cells = numbered.select(f"{name}.*", *keys, block.alias(f"{new}{cut}"), blocks.alias(f"{new}{copied}"))
        return cells.select(f"{name}.*", F.struct(*keys, f"{new}a", f"{new}b").cast(place).alias(cell)).repartition(tasks, cell)

    more, l, r = [F.expr(rest)] if rest else [], f"{names[0]}.*", f"{names[1]}.*"
    lc, rc = f"{new}lc", f"{new}rc"
    out = dealt(left, names[0], lk, lc, "a", "b").join(dealt(right, names[1], rk, rc, "b", "a").hint("shuffle_hash"), [*same([lc], [rc]), *more]).select(l, r)
    if how in ("left", "full"):
        alone = left.join(right if rest else right.select(*rk).distinct(), [*same(lk, rk), *more], "left_anti")
        out = out.union(alone.select(l, *_nulls(right.select(r))))
    if how in ("right", "full"):
        alone = right.join(left if rest else left.select(*lk).distinct(), [*same(rk, lk), *more], "left_anti")
        out = out.union(alone.select(*_nulls(left.select(l)), r))
    return out


def _nulls(side: DataFrame) -> list[Column]:
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema]


def _numbered(side: DataFrame, name: str) -> DataFrame:
    """With a number by which rows are cut into blocks, the same one if a task is run again: by their place, after sorting a task's rows by content where a shuffle may change their order."""
    if "Exchange" in side._jdf.queryExecution().executedPlan().toString():
        row = F.to_json(F.struct("*")) if "map<" in side.schema.simpleString() else F.struct("*")
        side = side.withColumn(name, F.xxhash64(row)).sortWithinPartitions(name)
    return side.withColumn(name, F.xxhash64(F.monotonically_increasing_id()))
