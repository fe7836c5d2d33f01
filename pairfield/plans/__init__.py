"""How a distance condition becomes a plan that Spark can partition."""
