"""Reading trades and markets, writing feature, sequence and report tables."""
