"""plumbline: DataFrame and SQL operators that measure where a predictor can be trusted."""
