"""Factor analytics on Spark: a typed expression language over date x symbol panels, and what is built on it."""
