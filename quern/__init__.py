"""quern: a Spark-first engine for hybrid text retrieval and corpus work."""

__version__ = "0.1.0"
