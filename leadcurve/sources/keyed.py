"""Tables by key that stay laid out by it, so that a refresh moves the changes alone.

A version of such a table is a folder of buckets by the hash of its key. Spark
knows the buckets when it reads them: joining changes by that key sends only
the changes over the network, however large the table is, and what comes out
of the join lies in the same buckets, so that writing the next version moves
nothing either. Which version is in use is one value of the config, switched
like the days of ``snapshots``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.operators.events import repeated_keys
from leadcurve.sources.snapshots import Config, RefusedWrite, folder_names, read_config, switch
from leadcurve.sources.tables import drop_folder


def _entry(name: str) -> str:
    return f"chaves:{name}"


def _place(root: str, name: str, version: str) -> str:
    return f"{root}/{name}/versao={version}"


def _quoted(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


@contextmanager
def _catalog_name(spark: SparkSession):
    """A name in the catalog while files are written or opened; the files are external and stay."""
    name = f"leadcurve_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"drop table if exists {name}")


def _opened(spark: SparkSession, path: str, about: dict) -> DataFrame:
    key = _quoted(about["chave"])
    with _catalog_name(spark) as name:
        spark.sql(
            f"create table {name} ({about['colunas']}) using parquet clustered by ({key}) sorted by ({key}) "
            f"into {about['baldes']} buckets location '{path}'"
        )
        return spark.table(name)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _written(rows: DataFrame, root: str, name: str, version: str, key: Sequence[str], buckets: int) -> dict:
    """Writes rows that lie in their buckets already; a repeated key, looked for bucket by bucket, refuses them."""
    spark, path = rows.sparkSession, _place(root, name, version)
    if folder_names(spark, path):
        raise ValueError(f"version {version} of {name} is there already")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    about = {"versao": version, "chave": list(key), "baldes": buckets, "colunas": columns}
    with _catalog_name(spark) as draft:
        rows.write.bucketBy(buckets, *key).sortBy(*key).option("path", path).format("parquet").saveAsTable(draft)
    repeated = _opened(spark, path, about).groupBy(*key).count().where("count > 1").agg(F.sum("count")).first()[0]
    if repeated:
        drop_folder(spark, path)
        raise RefusedWrite(name, repeated_keys(rows, *key), repeated)
    return about


def write_keyed(rows: DataFrame, root: str, name: str, version: str, key: Sequence[str], buckets: int | None = None) -> Config:
    """Writes rows as a table laid out by key and makes that version the one in use.

    Each key may be there once, null counting as a key; else ``RefusedWrite``
    is raised and the table stays as it was. There are at least as many
    buckets as shuffles have partitions, as Spark would rather deal a table
    with fewer of them anew.
    """
    spark = rows.sparkSession
    buckets = max(buckets or 1, _partitions(spark))
    config = read_config(spark, root)
    about = _written(rows.repartition(buckets, *key), root, name, version, key, buckets)
    return switch(spark, root, config, {_entry(name): about})


def read_keyed(spark: SparkSession, root: str, name: str, config: Config | None = None) -> DataFrame:
    """The table as a config has it, by default the current one, in its buckets."""
    about = (config or read_config(spark, root)).value(_entry(name), None)
    if about is None:
        raise ValueError(f"{name} is not in the config of {root}")
    return _opened(spark, _place(root, name, about["versao"]), about)


def refresh_keyed(spark: SparkSession, root: str, name: str, version: str, change: Callable[[DataFrame], DataFrame]) -> Config:
    """Replaces a table by what ``change`` makes of it, in one switch.

    ``change`` is a join by the table's key, such as ``apply_changes`` or
    ``upsert_creatives`` with their changes; only these are shuffled. Another
    one gives the same rows in more files. If the session's shuffles have
    come to have more partitions than the table has buckets, this refresh
    deals it anew into as many. A repeated key, or another writer in between,
    leaves the table as it was.
    """
    config = read_config(spark, root)
    about = config.value(_entry(name), None)
    if about is None:
        raise ValueError(f"{name} is not in the config of {root}")
    stored = read_keyed(spark, root, name, config)
    rows = change(stored).select(*stored.columns)
    buckets = max(about["baldes"], _partitions(spark))
    if buckets != about["baldes"]:
        rows = rows.repartition(buckets, *about["chave"])
    return switch(spark, root, config, {_entry(name): _written(rows, root, name, version, about["chave"], buckets)})


def sweep_keyed(spark: SparkSession, root: str, name: str, back: int = 1) -> list[str]:
    """Removes versions that neither the config nor the ``back`` ones before it name; returns their folders."""
    kept = [read_config(spark, root, n).value(_entry(name), {"versao": None})["versao"] for n in range(back + 1)]
    gone = [f"{root}/{name}/{f}" for f in folder_names(spark, f"{root}/{name}") if f.startswith("versao=") and f[7:] not in kept]
    for folder in gone:
        drop_folder(spark, folder)
    return gone
