"""Panel analytics on PySpark: declarative plans, DataFrame operators, no row-at-a-time Python."""
