"""siltstone subpackage."""
