"""specloom: a Spark-first engine for building, reconciling and querying wide specification catalogues."""

__version__ = "0.1.0"
