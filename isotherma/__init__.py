"""isotherma: ocean-heat analytics as Spark DataFrame operators."""
