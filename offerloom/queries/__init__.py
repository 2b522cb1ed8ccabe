"""Every job run on the given tables, with the same answer in SQL where SQL can give it."""

from offerloom.queries import pages, registry, serving, streams, text

AREAS = (text, pages, registry, serving, streams)


def all_queries():
    return {name: query for area in AREAS for name, query in area.QUERIES.items()}


def all_sql():
    return {name: sql for area in AREAS for name, sql in area.SQL.items()}
