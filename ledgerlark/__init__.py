"""Ledgerlark: analytics over regulatory filings, market data and text corpora on Spark DataFrames."""
