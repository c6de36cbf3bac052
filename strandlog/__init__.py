"""strandlog: a Spark-first engine for ordered text records."""
