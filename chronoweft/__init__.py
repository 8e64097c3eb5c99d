"""Timeline analytics on Spark: interval algebra, ordered sequences, signals and text as DataFrame operators."""
