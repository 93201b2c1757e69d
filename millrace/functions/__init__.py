"""Part of millrace; see the README for a map of the package."""
