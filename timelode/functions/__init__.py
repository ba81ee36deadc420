"""Timeline analytics: functions."""
