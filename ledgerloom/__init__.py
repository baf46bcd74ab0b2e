"""ledgerloom: invoice and spend analytics as Spark DataFrame operators."""
