"""Operations for training-data pipelines: one module per operator, one for their queries."""
