"""lexroute: retrieval analytics as declarative PySpark plans."""
