"""Timeline analytics: streaming."""
