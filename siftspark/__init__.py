"""siftspark: analytics over landed web pages and training documents, on PySpark."""

__version__ = "0.1.0"
