"""tickwise: technical indicators and their data work as Spark jobs."""

__version__ = "0.1.0"
