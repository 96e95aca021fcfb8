"""DataFrame operators: relational, aggregate, reshape, contingency tests, models, meta-analysis,
survival and resampling."""
