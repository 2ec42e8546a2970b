"""Learning and imputing from ring-valued aggregates, on Spark."""
