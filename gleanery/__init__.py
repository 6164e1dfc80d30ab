"""gleanery: evidence retrieval and corpus processing as Spark DataFrame pipelines."""

__version__ = "0.1.0"
