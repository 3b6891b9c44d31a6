"""Queries of the library's own operators: each module has QUERIES, name to (function, DuckDB SQL or None)."""
