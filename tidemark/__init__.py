"""Point-in-time fundamentals, event-study and price-signal analytics on Spark DataFrames."""
