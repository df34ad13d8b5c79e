"""nestql: hierarchical queries over relational data, planned as single lazy Spark programs."""
