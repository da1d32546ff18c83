"""Named query plans built from the operators."""
