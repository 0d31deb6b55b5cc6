"""Evidence-graph construction, batch grounded retrieval and training-data operators on Spark."""
