"""Queries over the test tables, each with SQL that gives the same rows."""

from townlake.plans import access, area_views, card, forms, live, matching, outlines, polygons, quality, registers, relational, shapes, transit

_PARTS = [access, relational, matching, transit, live, quality, shapes, forms, outlines, polygons, registers, card, area_views]

CITY_QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
CITY_ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
