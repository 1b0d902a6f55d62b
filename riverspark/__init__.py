"""riverspark: river-network and barrier analytics expressed as Spark plans."""
