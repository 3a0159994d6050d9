"""tabvet: Spark-native tabular data profiling, rule validation, repair,
synthesis and fidelity/privacy audit.

Every public operator takes and returns DataFrames and is built from
Spark Column expressions, joins, windows and aggregations; the driver
only ever collects fitted parameters (one row per column or category).
"""

__version__ = "0.1.0"
