"""What several operators of this subpackage share."""

from __future__ import annotations

import string
import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import settle

__all__ = ["BLANKS", "WORD", "ascii_lower", "documents", "drop_worker_state", "settle", "worker_state"]

#: ASCII white space, U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: A word: a longest run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` is used where the text is pure ASCII, as it is much faster than ``translate``."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_state(name: str, make):
    """A value that the Python worker keeps, so that tasks after the first find it filled; it goes when a task needs another one."""
    home = sys.modules.setdefault("_strataline_worker", types.ModuleType("_strataline_worker"))
    if name not in vars(home):
        drop_worker_state()
        setattr(home, name, make())
    return getattr(home, name)


def drop_worker_state() -> None:
    """Forget what earlier steps left in this Python worker, which the next step would hold beside its own."""
    home = sys.modules.get("_strataline_worker")
    for name in [n for n in vars(home) if not n.startswith("__")] if home else []:
        delattr(home, name)
