"""Plans: derived fixtures, the query catalog (Spark side + SQL oracle) and experiments."""
