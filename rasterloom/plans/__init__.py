"""Plans of the displacement engine."""
