"""Log and event analytics on Spark: sources, cleaning, windows, behaviour, issues, rollups."""
