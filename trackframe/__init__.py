"""Small-object detection, tracking and scoring on frame tables, in Spark."""

__version__ = "0.1.0"
