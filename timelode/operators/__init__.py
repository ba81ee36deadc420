"""Timeline analytics: operators."""
