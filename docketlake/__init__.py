"""docketlake: legal bulk-data ingest, search and citation analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
