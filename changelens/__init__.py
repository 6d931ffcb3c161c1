"""changelens: change-intelligence analytics as Spark DataFrame operators."""
