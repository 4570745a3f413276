"""tidemark: keyed sequential analytics, re-expressed as DataFrames.

Every table has a key, its first column.  Joins, unions and intersections are
implicit on that key; the mini SQL in ``tidemark.plans`` lowers to DataFrames
and Catalyst does the rest.
"""

__version__ = "0.1.0"
