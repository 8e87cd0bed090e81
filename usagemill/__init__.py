"""Usage accounting for agent activity logs, and training-data operators, as Spark DataFrame jobs."""
