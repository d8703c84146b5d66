"""Registered queries: ``(spark, sf_dir) -> DataFrame`` plus DuckDB oracle SQL.

Each module registers its queries with :func:`cinder.plans.registry.query`;
importing :mod:`cinder.plans.catalog` loads them all.
"""
