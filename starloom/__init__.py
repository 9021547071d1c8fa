"""A question-shaped query engine over star and snowflake catalogues, on Spark's own optimiser."""
