"""Record linkage and reconciliation on Spark."""
