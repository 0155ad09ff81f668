"""Operations for building training data.  Nothing outside imports this package."""
