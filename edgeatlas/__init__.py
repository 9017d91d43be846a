"""edgeatlas: evidence-carrying code graphs, built and queried with Spark."""
