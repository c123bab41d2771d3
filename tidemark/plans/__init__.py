"""The model graph, the warehouse models, and the queries over the driver's tables."""
