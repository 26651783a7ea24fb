"""The five steps end to end, composed from the operators."""
