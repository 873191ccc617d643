"""Real-time commerce mart as plain PySpark DataFrame functions."""
