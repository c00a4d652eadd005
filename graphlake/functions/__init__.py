"""Value semantics and scalar functions."""
