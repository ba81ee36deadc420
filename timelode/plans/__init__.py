"""Timeline analytics: plans."""
