"""beatframe: Spark operators for assembling short videos over tables of many plans."""
