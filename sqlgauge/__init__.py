"""Evaluation and data preparation for generated SQL, as PySpark DataFrame operators.

Every operator takes and returns DataFrames or Columns. Nothing is collected to
the driver; the few operators that run a job when called (row numbering, exact
percentiles, the query runner) say so in their docstring.
"""
