"""All queries of the library with the SQL that they are held against."""

from __future__ import annotations

from starloom.plans import catalogs, clustering, fields, observables, power, structures, tables, views

__all__ = ["catalogs", "clustering", "fields", "flagship", "observables", "oracle_sql", "power", "queries", "structures", "tables"]


def flagship(spark, sf_dir):
    """Correlation multipoles of density quantiles with the catalog."""
    return fields.density_split_cross(spark, sf_dir)


def queries():
    return dict(views.QUERIES)


def oracle_sql():
    return dict(views.SQL)
