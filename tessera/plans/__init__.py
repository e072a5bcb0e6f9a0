"""Registered queries of the engine, one module an area, each next to the SQL that checks it."""
