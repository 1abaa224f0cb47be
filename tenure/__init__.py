"""Customer lifetime, churn and survival analytics written as Spark jobs."""
