"""Source text -> facts."""
