"""Archive, inventory and transfer analytics as Spark DataFrame operators."""
