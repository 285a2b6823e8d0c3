"""The stages: clean, tokenise, aggregate, search, report."""
