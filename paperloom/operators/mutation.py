"""Inserts, upserts, deletes and import reports as new versions of a table.

Each function returns DataFrames; writing them back is the caller's choice of
format and mode.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _same(a: str, b: str, keys: Sequence[str]):
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return out


def insert_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(table with new keys, receipt for each row): inserted, or ignored.

    Of several new rows with one key the first is inserted.  A key with a null
    never collides, so such rows meet in no window and no join.
    """
    known = table.select(*keys).distinct().withColumn("_known", F.lit(True))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    met = rows.filter(whole).withColumn("_n", n).join(known, list(keys), "left")
    met = met.withColumn("status", F.when(F.col("_known").isNull() & (F.col("_n") == 1), "inserted").otherwise("ignored")).select(*rows.columns, "status")
    judged = met.unionByName(rows.filter(~whole).withColumn("status", F.lit("inserted")))
    added = judged.filter("status = 'inserted'").select(*table.columns)
    return table.unionByName(added), judged.select(*rows.columns, "status")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The table with rows put in their key's place; the latest row of a key wins."""
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").select(*table.columns)
    return table.join(last.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(last)


def import_report(table: DataFrame, rows: DataFrame, keys: Sequence[str], values: Sequence[str], version: str) -> DataFrame:
    """(action, n): what an import would do to each incoming row.

    insert, noop (all values equal), older (would overwrite a later version) or
    update.
    """
    old = table.select(*keys, F.struct(*values).alias("_old"), F.col(version).alias("_ov"), F.lit(True).alias("_has"))
    new = rows.select(*keys, F.struct(*values).alias("_new"), F.col(version).alias("_nv"))
    action = F.when(F.col("_has").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col("_new")), "noop").when(F.col("_nv") < F.col("_ov"), "older").otherwise("update")
    return new.join(old, list(keys), "left").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def update(table: DataFrame, changes: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """The table with allowed columns replaced where a change has a value."""
    return updates(table, changes, keys, allowed).select(*(F.col(c) if c not in allowed else F.col(f"after.{c}").alias(c) for c in table.columns))


def updates(table: DataFrame, changes: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """All rows with before and after images of the allowed columns, and what was done.

    status is updated, noop (no value differs) or untouched (no change has the key).
    """
    c = changes.select(*keys, F.struct(*allowed).alias("_change"), F.lit(True).alias("_has"))
    before = F.struct(*allowed)
    after = F.struct(*(F.coalesce(F.col("_change").getField(x), F.col(x)).alias(x) for x in allowed))
    out = table.join(c, list(keys), "left").withColumn("before", before).withColumn("after", after)
    status = F.when(F.col("_has").isNull(), "untouched").when(F.col("before").eqNullSafe(F.col("after")), "noop").otherwise("updated")
    return out.withColumn("status", status).drop("_change", "_has")


def insert_absent_any(table: DataFrame, rows: DataFrame, key_sets: Sequence[Sequence[str]], order: str, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(order, status) of rows inserted one after another under several unique keys.

    A row is ignored if the table or an earlier inserted row has its value of
    any key set; a key with a null collides with nothing.  Each round inserts all
    open rows that are the first of every key of theirs, then ignores the open
    rows that share a key with them, so rounds follow chains of collisions.
    ``checkpoint`` writes the table between rounds.
    """

    def keyed(df: DataFrame, *more: str) -> DataFrame:
        each = F.array(*(F.struct(F.lit(i).alias("s"), F.concat_ws("\x1f", *(F.col(k).cast("string") for k in ks)).alias("v"), F.array(*(F.col(k).isNull() for k in ks)).alias("n")) for i, ks in enumerate(key_sets)))
        return df.select(*more, F.explode(each).alias("k")).filter(~F.exists("k.n", lambda x: x)).select(*more, "k.s", "k.v")

    keys = checkpoint(keyed(rows, order))
    held = keys.join(keyed(table).distinct(), ["s", "v"], "left_semi").select(order).distinct().withColumn("_held", F.lit("ignored"))
    state = checkpoint(rows.select(order).join(held, order, "left").select(order, F.coalesce("_held", F.lit("open")).alias("status")))
    while not state.filter("status = 'open'").isEmpty():
        live = keys.join(state.filter("status = 'open'").select(order), order)
        first = live.groupBy("s", "v").agg(F.min(order).alias("_first"))
        later = live.join(first, ["s", "v"]).filter(F.col(order) > F.col("_first")).select(order, "_first").distinct()
        blocked = later.select(order).distinct().withColumn("_blocked", F.lit(True))
        now = state.filter("status = 'open'").join(blocked, order, "left")
        fresh = checkpoint(now.filter("_blocked is null").select(F.col(order).alias("_first")))
        loser = later.join(fresh, "_first", "left_semi").select(order).distinct().withColumn("_lost", F.lit(True))
        won = fresh.select(F.col("_first").alias(order), F.lit(True).alias("_won"))
        decided = F.when(F.col("_won"), "inserted").when(F.col("_lost"), "ignored").otherwise(F.col("status"))
        state = checkpoint(state.join(won, order, "left").join(loser, order, "left").select(order, decided.alias("status")))
    return state


def delete(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*table.columns)


def replace_group(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the incoming groups replaced by the incoming rows."""
    return delete(table, rows, keys).unionByName(rows.select(*table.columns))


def null_references(table: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The table with references to deleted rows set to null."""
    g = gone.select(F.col(column).alias("_g")).distinct()
    out = table.join(g, F.col(column) == F.col("_g"), "left")
    return out.withColumn(column, F.when(F.col("_g").isNull(), F.col(column))).select(*table.columns)


def receipts(rows: DataFrame, library: DataFrame, key: str, order: str) -> DataFrame:
    """What an import does with each record, by its key, in input order.

    added, exists (already in the library), duplicate (an earlier record of the
    batch has the key) or unresolved (no key).
    """
    known = library.select(F.col(key).alias("_k")).filter("_k is not null").distinct()
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    judged = rows.filter(F.col(key).isNotNull()).withColumn("_n", n).join(known, F.col(key) == F.col("_k"), "left")
    status = F.when(F.col("_k").isNotNull(), "exists").when(F.col("_n") > 1, "duplicate").otherwise("added")
    judged = judged.withColumn("status", status).select(*rows.columns, "status")
    return judged.unionByName(rows.filter(F.col(key).isNull()).withColumn("status", F.lit("unresolved")))
