"""Plan-level helpers (staging, skew) and multi-operator pipelines."""
