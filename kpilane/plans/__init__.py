"""Query plans: reports, the named query catalogue and its SQL oracle."""
