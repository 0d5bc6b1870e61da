"""Time-series panels and research experiments on Spark."""
