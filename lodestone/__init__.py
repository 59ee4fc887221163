"""Secret-findings analytics and data preparation on PySpark."""
