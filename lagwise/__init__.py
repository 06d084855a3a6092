"""Lead-lag analytics on Spark: panels, directed graphs, curvature, validation, selection."""

__version__ = "0.1.0"
