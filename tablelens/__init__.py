"""Table-level analytics operators on Spark DataFrames.

Every public operator takes DataFrames and returns a DataFrame (or a
dictionary of them); see README.md for the operator list.
"""

__version__ = "0.1.0"


class TableError(ValueError):
    """A table, column or operation does not satisfy an operator's contract."""
