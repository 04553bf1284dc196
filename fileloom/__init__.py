"""File-intelligence engine on Spark: duplicates, keepers, reconciliation, naming and search over
tables of files, as DataFrame transformations."""
