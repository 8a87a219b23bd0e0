"""Log analytics on Spark DataFrames: washing, template mining, rules, features, models and reports."""
