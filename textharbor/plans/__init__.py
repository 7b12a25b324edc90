"""Query language and its translation to DataFrame plans."""
