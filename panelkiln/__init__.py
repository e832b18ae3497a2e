"""Feature expressions over entity-by-month panels on Spark, their evaluation and search."""
