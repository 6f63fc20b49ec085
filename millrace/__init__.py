"""millrace: data assurance, retrieval and usage analytics as lazy PySpark operators."""
