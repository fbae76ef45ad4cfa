"""Legal-text retrieval, evaluation and data-quality analytics on PySpark DataFrames."""

__version__ = "0.1.0"
