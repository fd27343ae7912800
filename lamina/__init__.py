"""lamina: a Spark-first engine that turns document collections into analysed question/answer decks."""

__version__ = "0.1.0"
