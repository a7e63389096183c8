"""spanloom subpackage."""
