"""Ravelin: a Spark-native engine for searching and analysing code and documents.

Every operator is a function from DataFrames to a DataFrame.  Python runs inside
executors only where a built-in expression cannot state the semantics.
"""

__version__ = "0.1.0"
