"""Column expressions: text cleaning, tokenizing, stemming, scalars."""
