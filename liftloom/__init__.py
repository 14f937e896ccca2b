"""Session conversion analytics on Spark: sessions, conversion counts, goal scoring and action choice."""
