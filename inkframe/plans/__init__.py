"""Input plans for the registered queries."""
