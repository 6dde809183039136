"""Part of rasterloom; see README.md."""
