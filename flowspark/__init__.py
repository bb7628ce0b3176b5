"""Network-flow analytics as Spark DataFrame jobs: packets, flows, features, scores and alerts."""
