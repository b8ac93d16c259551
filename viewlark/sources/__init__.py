"""File formats, and the one door to them: ``read(spark, Format.CSV, path)`` and ``write(table, Format.CSV, path)``."""

from .files import Format, TableIO, read, write

__all__ = ["Format", "TableIO", "read", "write"]
