"""stacklens: dependency-compatibility and outcome-learning analytics on Spark."""
