"""Timeline analytics: sources."""
