"""All queries of the core, with the SQL that checks them."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from caseloom.queries import agreements, mails, measures, records, texts

_ALL = texts.Q | records.Q | measures.Q | mails.Q | agreements.Q


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}


_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Gives the executors this package, once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="caseloom-")) / "caseloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shipped(query: Callable) -> Callable:
    """The query, run with the package shipped."""

    @functools.wraps(query)
    def run(spark, folder: str):
        ship(spark)
        return query(spark, folder)

    return run
