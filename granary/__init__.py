"""granary: corpus analytics on Spark."""
