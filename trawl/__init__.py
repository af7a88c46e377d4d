"""Search, linking and investigation of entity records on Spark."""
