"""Contest analytics on Spark: leak-free form features, ratings, in-game state and model monitoring."""
