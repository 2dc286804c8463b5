"""millrace: DataFrame-in, DataFrame-out analytics jobs for PySpark.

The package holds plain Spark plans only.  ``sources`` reads and writes files and
tables, ``functions`` holds column expressions, ``operators`` holds the table-level
jobs, and ``plans`` binds them to a table directory together with reference SQL.
"""

__version__ = "0.1.0"
