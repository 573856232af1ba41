"""cairn: document retrieval and analytics as PySpark plans."""
