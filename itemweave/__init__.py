"""itemweave: DataFrame-first analytics over semi-structured item banks."""
