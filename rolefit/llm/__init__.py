"""Operations on training text: cleaning, deduplication, mixing, tokens, search. Nothing else in the library imports this."""
