"""Design and evaluation of demand-responsive transit districts as Spark DataFrame programs."""
