"""Mining and classification of event sequences as Spark DataFrame jobs."""

__version__ = "0.1.0"
