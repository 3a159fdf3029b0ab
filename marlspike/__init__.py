"""A Spark-first engine for document-grounded question answering and the records around it."""

__version__ = "0.1.0"
