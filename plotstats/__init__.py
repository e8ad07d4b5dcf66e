"""plotstats — nested plot-survey statistics as Spark DataFrame operators.

Survey tables (tree measurements, heights, canopy densiometer readings,
regeneration counts, sapling heights, water-quality readings, plot
coordinates) come in as DataFrames; every operator is a lazy
``DataFrame -> DataFrame`` function built from Spark SQL expressions:

* ``plotstats.sources``    – declared schemas, table and workbook loaders, row order,
  sheet checks, exporter, and the mapping that derives survey tables from the
  TPC-H-like test tables.
* ``plotstats.functions``  – Column expressions (basal area, standard error,
  size classes, "mean ± SE" text, display names).
* ``plotstats.plans``      – reusable plan shapes: reading → plot → site
  aggregation, reshapes, null-safe merges, session settings.
* ``plotstats.operators``  – the statistics themselves.
"""

__version__ = "0.1.0"
