"""Joins, windows and aggregates over trades, tokens and scores."""
