"""Index building, scoring, search, hierarchy and evaluation."""
