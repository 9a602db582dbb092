"""Document-box analytics on Spark: declarative operators over text boxes."""
