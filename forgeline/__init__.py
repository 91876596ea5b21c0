"""forgeline: a Spark-first engine for industrial material catalogs."""
