"""One query for every family of physical operators that plans name."""

from plansmith.operators import aggregates, dml, exchanges, joins, scans, sets, stored, windows

__all__ = ["aggregates", "dml", "exchanges", "joins", "scans", "sets", "stored", "windows"]
