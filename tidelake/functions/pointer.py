"""Object paths: an object's fields are rows named ``path#/key``, keys escaped as in RFC 6901. Python and Column forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "#/"


def escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def unescape(key: str) -> str:
    return key.replace("~1", "/").replace("~0", "~")


def pointer(path: str, key: str) -> str:
    return f"{path}{MARK}{escape(key)}"


def split_pointer(name: str) -> tuple[str, str] | None:
    """(object path, key) at the first mark, or None for a plain path."""
    path, mark, key = name.partition(MARK)
    return (path, unescape(key)) if mark else None


def escape_column(key: Column) -> Column:
    """FUN-6."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_column(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def is_field(path: Column) -> Column:
    return F.contains(path, F.lit(MARK))


def object_path(path: Column) -> Column:
    """PRJ-3: the part before the first mark; a plain path stays."""
    return F.split_part(path, F.lit(MARK), F.lit(1))


def field_key(path: Column) -> Column:
    """PRJ-4, FUN-7: the unescaped key of a field row, null for a plain path."""
    at = F.locate(MARK, path)
    return F.when(at > 0, unescape_column(F.substr(path, at + len(MARK))))
