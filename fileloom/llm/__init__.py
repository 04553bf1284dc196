"""Training-data operators on document tables. Nothing outside this folder imports it."""
