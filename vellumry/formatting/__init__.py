"""The document formatter: pure functions on one document."""
