"""Readers."""

from keydrift.sources.delimited import ROW_ORDER, read_delimited

__all__ = ["ROW_ORDER", "read_delimited"]
