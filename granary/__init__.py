"""granary: a Spark engine for content-addressed file, archive and image data."""

__version__ = "0.1.0"
