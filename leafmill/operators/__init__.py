"""Part of the package."""
