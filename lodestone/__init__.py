"""Analytics over matrices, neighbour graphs, counts and documents, as Spark DataFrame operators."""
