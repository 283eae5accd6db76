"""tidewright: corpus curation and detection analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
