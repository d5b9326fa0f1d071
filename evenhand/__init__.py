"""Group-fair binary classification over client-partitioned tables, as PySpark DataFrame operators."""
