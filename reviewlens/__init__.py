"""Review analytics as Spark jobs: catalogue search, terms, topics and opinions."""
