"""Table upkeep as pure DataFrame steps: old version in, new version out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_missing(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Adds the rows whose key the table does not hold; existing rows win.

    Of several new rows with one key the smallest, compared column by column,
    is added.
    """
    new = rows.join(table.select(*key), list(key), "left_anti")
    first = new.groupBy(*key).agg(F.expr(f"min(struct({', '.join(rows.columns)})) as _first"))
    return table.unionByName(first.select("_first.*"), allowMissingColumns=True)


def _matched(table: DataFrame, changes: DataFrame, key: tuple[str, ...], op: str) -> DataFrame:
    """Table rows (``_old``) beside the changes of their key (``_new``, ``_op``), with ``motivo`` if these are refused."""
    old = table.select(*key, F.struct(*table.columns).alias("_old"))
    # columns are compared only to settle on one row; several changes of a key are refused anyway
    new = changes.groupBy(*key).agg(
        F.expr("count(*) as _changes"), F.expr(f"min(struct({op} as _op, {', '.join(table.columns)})) as _new")
    )
    reason = (
        "case when _changes > 1 then 'repetida' when _new._op = 'insert' and _old is not null then 'existente' "
        "when _new._op in ('update', 'delete') and _old is null then 'ausente' "
        "when _new._op not in ('insert', 'update', 'delete') or _new._op is null then 'operacao' end"
    )
    return old.join(new, list(key), "full_outer").selectExpr("*", f"if(_changes is null, null, {reason}) as motivo")


def apply_changes(table: DataFrame, changes: DataFrame, *key: str, op: str = "op") -> DataFrame:
    """Applies changes by their operation: ``insert`` and ``update`` carry the full row, ``delete`` the key.

    An insert adds a new key, an update changes an existing one, a delete
    removes it. Changes that ``change_rejects`` lists have no effect. One
    full outer join of table and changes.
    """
    done = _matched(table, changes, key, op).selectExpr(
        "case when _changes is null or motivo is not null then _old when _new._op != 'delete' then "
        f"named_struct({', '.join(f'{c!r}, _new.{c}' for c in table.columns)}) end as _row"
    )
    return done.where("_row is not null").select("_row.*")


def change_rejects(table: DataFrame, changes: DataFrame, *key: str, op: str = "op") -> DataFrame:
    """Keys whose changes are refused, with their number and ``motivo``.

    ``repetida``: several changes of one key; ``existente``: an insert of a
    key that is there; ``ausente``: an update or delete of one that is not;
    ``operacao``: an unknown operation.
    """
    refused = _matched(table, changes, key, op).where("motivo is not null")
    return refused.selectExpr(*key, "_changes as mudancas", "motivo")


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Rows replace those of the same key; the rest stays."""
    return table.join(rows.select(*key), list(key), "left_anti").unionByName(rows)


def to_layout(table: DataFrame, layout: DataFrame) -> DataFrame:
    """Columns of an older layout brought to the current one, missing ones null."""
    widened = layout.limit(0).unionByName(table, allowMissingColumns=True)
    return widened.select(*layout.columns)
