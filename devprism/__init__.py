"""Developer profiling on Spark DataFrames: mining, text, topics, sentiment, features, clusters."""
