"""Text governance on Spark: detection, masking, policy joins, decisions and audit as DataFrame operators."""

__version__ = "0.1.0"
