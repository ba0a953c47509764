"""delaymart: daily-delay analytics on Spark (Bronze CSV -> Silver -> Gold)."""

__version__ = "0.1.0"
