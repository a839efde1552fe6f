"""One guarded door for SQL over a library's tables, and the registry of named operations.

Statements are written as for the small database that such libraries come from, so the session has the functions that they may use: ``group_concat``, ``strftime``, ``json_extract``
and the table function ``json_each`` (after LATERAL). ``ilike`` matches without case. Casts are lenient: what can't be cast is null. Texts can be compared without case in all of a statement (``nocase``). Whole numbers divide by ``div``; columns that are
neither grouped nor aggregated are written ``any_value(x)``; nulls come first in ascending orders, as there.
"""

from __future__ import annotations

import threading
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from ..stored import stored

ROWS = 100
HIDDEN = ("structure_json",)
#: One statement at a time has its tables' names in the session.
_DOOR = threading.RLock()


class Refused(ValueError):
    pass


def guarded(statement: str) -> str:
    """The statement, if it begins with SELECT and holds no semicolon but a last one (not even inside a literal)."""
    text = statement.strip()
    if not text.upper().startswith("SELECT"):
        raise Refused("only SELECT is allowed")
    if ";" in text[:-1]:
        raise Refused("one statement only")
    return text.rstrip(";")


#: What parts of a moment are written as in a format of strftime: fixed values.
PARTS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def functions(spark: SparkSession) -> None:
    """The functions of the door, as temporary ones of the session."""
    at = "try_cast(case when moment = 'now' then cast(now() as string) else moment end as timestamp_ntz)"
    shown = "form"
    for sign, part in PARTS.items():
        shown = f"replace({shown}, '{sign}', date_format({at}, '{part}'))"
    shown = f"replace({shown}, '%w', cast(dayofweek({at}) - 1 as string))"
    spark.sql(f"create or replace temporary function strftime(form string, moment string) returns string return {shown}")
    spark.sql("create or replace temporary function json_extract(doc string, path string) returns string return get_json_object(doc, path)")
    spark.sql("""create or replace temporary function json_each(doc string) returns table(key string, value string)
        return select coalesce(e.key, cast(e.pos as string)), cast(e.value as string) from variant_explode(try_parse_json(doc)) as e""")

    def joined(values: pd.Series, *between: pd.Series) -> str | None:
        kept = [str(v) for v in values if v is not None and v == v]
        return (between[0].iloc[0] if between else ",").join(kept) if kept else None

    with warnings.catch_warnings():  # any number of arguments can't be told by type hints
        warnings.simplefilter("ignore")
        spark.udf.register("group_concat", F.pandas_udf(joined, "string", PandasUDFType.GROUPED_AGG))


@contextmanager
def _named(spark: SparkSession, tables: dict[str, DataFrame], hidden: tuple[str, ...], settings: dict[str, str]) -> Iterator[None]:
    """The tables as views, and the settings, while a statement is resolved; views and settings of the same names are as before afterwards."""
    views = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in tables if name in views}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for name, rows in tables.items():
            rows.drop(*hidden).createOrReplaceTempView(name)
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def without_case(rows: DataFrame) -> DataFrame:
    """The table with texts that compare and match without case."""
    return rows.select(*[F.collate(c, "UTF8_LCASE").alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes])


def query(spark: SparkSession, statement: str, tables: dict[str, DataFrame] | None = None, rows: int = ROWS, hidden: tuple[str, ...] = HIDDEN, nocase: bool = False) -> DataFrame:
    """At most ``rows`` rows of a guarded statement over the tables, whose hidden columns aren't for such statements. Other tables and views of the session can be named too."""
    text = guarded(statement)
    own = {k: without_case(v) if nocase else v for k, v in (tables or {}).items()}
    with _DOOR, _named(spark, own, hidden, {"spark.sql.ansi.enabled": "false"}):
        functions(spark)
        return spark.sql(text).limit(rows)


class Operations(dict[str, Callable[..., DataFrame]]):
    """Named operations. An unknown name, wrong arguments, or a call that fails while it is planned or run gives the error as data."""

    def call(self, spark: SparkSession, name: str, **arguments) -> DataFrame:
        """The operation's rows, all of them, written as a table here, so that what goes wrong in them is caught."""
        if name not in self:
            return spark.createDataFrame([(f"unknown operation: {name}",)], "error string")
        try:
            return stored(self[name](**arguments), "answer")
        except Exception as e:  # noqa: BLE001 - errors are data here
            return spark.createDataFrame([(str(e)[:500],)], "error string")
