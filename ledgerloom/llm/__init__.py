"""Training-data operators on Spark: each module is one operator, ``registry`` lists their queries."""
