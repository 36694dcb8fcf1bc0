"""Training-data operators: one module per operator, on Spark DataFrames.

Nothing else in the library imports this subpackage.  ``queries`` registers the
operators for the driver.
"""
