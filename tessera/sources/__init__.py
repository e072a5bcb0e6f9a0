"""Record stores and readers."""
