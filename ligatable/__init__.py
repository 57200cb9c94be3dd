"""Drug-target affinity analytics as plain PySpark DataFrame operators."""
