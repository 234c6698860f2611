"""Write a result whole or not at all, and go on where an earlier run was cut off."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from quotelens.sources.staging import Staging


def run_key(tables: Mapping[str, DataFrame], *settings: object, version: str | None = None) -> str:
    """A name for a run over these inputs with these settings.

    Inputs are told apart by the names and columns of their files, which Spark never
    writes anew under an old name. ``version`` stands for them where the caller knows
    better, or where a table has no files.
    """
    said = hashlib.sha256(repr(settings).encode())
    if version is not None:
        said.update(version.encode())
    else:
        for name in sorted(tables):
            files = sorted(tables[name].inputFiles())
            if not files:
                raise ValueError(f"{name} has no files; give the inputs a version")
            for part in (name, tables[name].schema.simpleString(), *files):
                said.update(f"{len(part)}:{part}".encode())
    return said.hexdigest()[:32]


def commit(
    spark: SparkSession,
    build: Callable[[Staging], DataFrame],
    target: str,
    key: str,
    folder: str | None = None,
    order: tuple[str, ...] = (),
) -> bool:
    """Write what ``build`` returns to ``target``, in ``order``, and drop its staged tables.

    The result is written beside ``target`` and renamed, marked with ``key``: readers
    see the whole of it or nothing, on file systems that rename at once. Cut off
    anywhere, the same call goes on after the last staged table; once done, it finds
    its mark, clears what is left and returns False. A target of another run is an
    error: it is never overwritten. Files follow ``order`` by ranges, so that a reader
    who asks for some of its values opens few of them.
    """
    place = target.rstrip("/")
    staging = Staging(spark, folder, required=True, key=key)
    marked, files = staging._file_system(f"{place}/_run-{key}")
    whole, _ = staging._file_system(place)
    if files.exists(marked):
        staging.delete()
        return False
    if files.exists(whole):
        raise ValueError(f"{target} holds another result")
    beside = f"{place}.writing-{key}"
    with staging:
        out = build(staging)
        if order:
            out = out.repartitionByRange(*order).sortWithinPartitions(*order)
        out.write.mode("overwrite").parquet(beside)
        at, _ = staging._file_system(beside)
        mark, _ = staging._file_system(f"{beside}/_run-{key}")
        files.create(mark).close()
        if not files.rename(at, whole):
            raise OSError(f"{beside} could not be renamed to {target}")
    return True
