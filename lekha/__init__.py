"""Text-corpus jobs on Spark: dictionaries, spelling, listings, search, repair."""
