"""Document intelligence on Spark: typed property graphs, retrieval and mining as DataFrame operators."""
