"""cinder: burned-area analytics as composable Spark DataFrame operators.

Sub-packages
------------
functions  column-expression helpers (hash-uniform, labels, names, cleaning)
sources    readers, the pixel-month fixture view, file/name parsing, sinks
operators  DataFrame -> DataFrame operators (geometry, coarse grids, sampling,
           metrics, masks, zonal area, diagnostics, models)
plans      the registered queries and their DuckDB oracle SQL
streaming  incremental ingest and incremental annual masks
"""

__version__ = "0.1.0"
