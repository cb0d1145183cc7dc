"""Text-record quality and similarity engine on Spark."""
