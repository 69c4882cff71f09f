"""Plan-first analytics on Spark: typed query plans, catalog profiles, gates, retrieval and evaluation as DataFrame jobs."""
