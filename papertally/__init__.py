"""papertally: reconcile extracted document data with business records on Spark.

Every operator is a function from DataFrames (plus small configuration) to a
DataFrame.  Nothing here triggers a Spark action unless its docstring says so.
"""

__version__ = "0.1.0"
