"""Text and label operators for training-data work; nothing outside this subpackage imports it."""
