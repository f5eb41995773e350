"""veilframe: document anonymisation analytics on PySpark."""
