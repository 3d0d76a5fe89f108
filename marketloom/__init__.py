"""Market-data analytics on Spark: bars, indicators, as-of reads, range algebra,
bitemporal reference data, provider shaping, versioned tables and live streams."""

__version__ = "0.1.0"
