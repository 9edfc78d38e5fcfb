"""Expression and plan helpers shared by the operators."""
