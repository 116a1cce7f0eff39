"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import candidates, corpus, decode, glyphs, models, raster, recognise

MODULES = (recognise, corpus, candidates, raster, glyphs, decode, models)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
