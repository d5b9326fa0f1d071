"""The batch metrics, unchanged, on streams of scored rows."""
