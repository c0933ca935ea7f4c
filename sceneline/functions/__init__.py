"""Part of Sceneline; see the package docstring."""
