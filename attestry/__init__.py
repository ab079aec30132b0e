"""Attestry: product-catalog enrichment and data-quality checks as Spark jobs.

Every transform is a function from DataFrames to a DataFrame.  One rule holds
throughout: a value without evidence stays NULL and the row is flagged.
"""

__version__ = "0.1.0"
