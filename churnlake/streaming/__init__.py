"""Event-time windows and streaming flows."""
