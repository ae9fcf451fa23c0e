"""Small helpers that other modules share."""
