"""tarnmill: corpus building and experiment analytics as Spark DataFrame operators."""
