"""orderlens: sales-order analytics as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver. See README.md for the operator list.
"""

__version__ = "0.1.0"
