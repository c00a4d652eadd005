"""Query texts to DataFrame plans."""
