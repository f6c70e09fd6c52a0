"""Analytics of database execution plans."""
