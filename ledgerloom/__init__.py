"""ledgerloom: causal trade features, sequence tables and training-corpus jobs on Spark."""
