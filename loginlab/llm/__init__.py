"""Operations for training-data pipelines."""
