"""Messages delivered more than once: keep one copy of each, and admit later batches against stored ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space trimmed from both ends of identifiers, the no-break space included.
OUTER_BLANKS = r"^[\s\x{00a0}]+|[\s\x{00a0}]+$"


def identifier(column: str | Column) -> Column:
    """An identifier without letter case and outer blanks; null stays null, a blank one becomes ''."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(c, OUTER_BLANKS, ""))


def _known(keys: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (k.isNotNull() for k in keys))


def keep_first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """Exactly one row of each identifier: the first by the ``order`` columns, ascending with nulls last.

    Rows are partitioned by identifier and ranked; only rank 1 stays. Catalyst turns the rank filter into a group
    limit that runs before the shuffle too, so a hot identifier reaches its partition as one row per input task.
    Null keys never equal one another: those rows all stay. ``order`` should end in something unique; rows equal in
    all of it are interchangeable and one of them stays. An empty table gives an empty table.
    """
    row, rank = fresh_names(df.columns, "row", "rank")
    names = fresh_names(df.columns, *(f"key{i}" for i in range(len(keys))))
    # The row travels as one struct, so that no column of its own can clash with the ones added.
    keyed = df.select(F.struct(*(df[c] for c in df.columns)).alias(row), *(k.alias(n) for n, k in zip(names, keys)), F.struct(*_sortable(order)).alias(rank))
    known = _known([F.col(n) for n in names])
    w = Window.partitionBy(*names).orderBy(rank)
    first = keyed.filter(known).withColumn("n", F.row_number().over(w)).filter("n = 1").select(f"{row}.*")
    return first.unionByName(keyed.filter(~known).select(f"{row}.*"))


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, lengthened until none equals a taken one, letter case aside."""
    used, out = {t.lower() for t in taken}, []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out


def _sortable(order: list[str]) -> list[Column]:
    """Struct fields that sort as ``order`` ascending with nulls last."""
    return [x for i, o in enumerate(order) for x in (F.col(o).isNull().alias(f"null{i}"), F.col(o).alias(f"value{i}"))]


def later_copies(df: DataFrame, row_id: str, keys: list[Column], order: list[str]) -> DataFrame:
    """The ``row_id`` of every row that keep_first() drops; ``row_id`` must be unique and not null.

    The first of each identifier is a minimum over (order, row_id), combined before the shuffle; the rest follow
    from an anti-join on the unique row_id, so no task ever holds a hot identifier's rows.
    Nulls in ``order`` come after all values.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    rank = F.struct(*_sortable(order), F.col(row_id).alias("__row"))
    keyed = df.select(F.col(row_id), rank.alias("__rank"), *(k.alias(n) for n, k in zip(names, keys)))
    keyed = keyed.filter(_known([F.col(n) for n in names]))
    first = keyed.groupBy(*names).agg(F.min("__rank").alias("__first")).select(F.col("__first.__row").alias(row_id))
    return keyed.select(row_id).join(first, row_id, "left_anti")


def admit(batch: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a new batch whose identifier is not stored yet, one of each.

    ``keys`` name columns of both tables and are compared by identifier(). Null identifiers are always admitted.
    """
    fresh = keep_first(batch, [identifier(k) for k in keys], order)
    row, *names = fresh_names(batch.columns, "row", *(f"key{i}" for i in range(len(keys))))
    keyed = fresh.select(F.struct(*(fresh[c] for c in fresh.columns)).alias(row), *(identifier(k).alias(n) for n, k in zip(names, keys)))
    seen = stored.select(*(identifier(k).alias(n) for n, k in zip(names, keys))).distinct()
    return keyed.join(seen, names, "left_anti").select(f"{row}.*")
