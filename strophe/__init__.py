"""strophe: a Spark-first engine for timed-text catalogs."""
