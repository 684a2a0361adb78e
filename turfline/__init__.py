"""turfline: match-observation analytics as PySpark DataFrame operators."""
