"""The operators run on the driver's tables, and the same results in plain SQL."""
