"""Named plans: table adapters, the query catalogue and its SQL counterparts."""
